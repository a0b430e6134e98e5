"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
from millrace.llm import kdshards, lattice, licenses, ngram_join, packing, quality, queries, toxicity, transducer, varbyte, winnow
from millrace.operators import testing

SF = "/root/testdata/sf0.001"
LOW = re.compile("[A-Z]")
SPACED = re.compile(r"[^ \t-\r]+")


def low(t):
    return LOW.sub(lambda m: m[0].lower(), t or "")


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
BASE = " ".join(WORDS[(i * 7 + i // 3) % 16] + str(i) for i in range(60))
TEXTS = [None, "", "   \n ", "one", "one two three", BASE, BASE, BASE.upper(), BASE.replace("alpha0", "other"), " ".join(reversed(BASE.split())), "don't <|endoftext|> É é 😀 x\x00y", "a " * 9000, "z" * 5000, "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + licenses.MIT, "x\nx\nx y\n\nx y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "src", 1.5, "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "a null id", "en", "src", 0.0, "x")]  # a repeated row, and one without an id
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars double, n_tokens string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_sql_queries(spark):
    for name, sql in queries.SQL.items():
        assert testing.compare(spark, "/root/testdata/sf0.01", queries.QUERIES[name], sql) == ""


def test_licenses(spark, docs, empty):
    known = licenses.all_digests(spark)
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, known).collect()}
    assert {k for k, v in got.items() if v} == {13} and got[13] == "MIT"
    assert licenses.notices(empty, licenses.NOTICES).count() == 0
    one = spark.createDataFrame([("Hello\nRELEASED under the MIT licence\n",)], "text string")
    assert licenses.notices(one, licenses.NOTICES).first().notice_ids == "MIT"


def test_licences_are_found_however_wrapped(spark):
    import os
    import textwrap

    head = "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n(c) 2021 Another\n\n"
    texts = [head + "\n\n".join(textwrap.fill(p, w) for p in licenses.MIT.split("\n\n")) for w in (61, 62, 72, 80, 81, 82, 200)]
    texts += [head + licenses.MIT + " and more"]
    got = [r.license_id for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), licenses.all_digests(spark)).orderBy("i").collect()]
    assert got == ["MIT"] * 7 + [None]
    folder = "/usr/share/common-licenses"
    if os.path.exists(f"{folder}/GPL-3"):
        with open(f"{folder}/GPL-3") as f:
            assert licenses.scan(spark.createDataFrame([(f.read(),)], "text string"), licenses.all_digests(spark)).first().license_id == "GPL-3.0"
    # No bound on a line, and none on what a notice says.
    long = spark.createDataFrame([("x\n" + "*" * 3000 + " Dual use, public DOMAIN " + "-" * 3000,)], "text string")
    assert licenses.notices(long, [("X", "Dual use, public domain")]).first().notice_ids == "X"


def test_shards(docs, empty):
    from pyspark.sql import functions as F

    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    rows = kdshards.kd_shards(docs, ["n_chars", "source", "lang"], size, leaves=4).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert kdshards.kd_shards(empty, ["source"], size, leaves=4).count() == 0


def test_shards_are_near_equal(spark):
    rows = queries.QUERIES["op2_kd_shards"](spark, "/root/testdata/sf0.01").collect()
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    mean, longest = sum(total.values()) / 24, max(r.size for r in rows)
    assert len(total) == 24 and all(abs(v - mean) <= longest for v in total.values())


def test_winnowing(spark, docs, empty, monkeypatch):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = [(1, " ".join(BASE.split()[20:34])), (2, "one two"), (3, None), (4, ""), (5, "x y"), (5, "a a a a a a a a a a a")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for i, t in enumerate(TEXTS):
        w, hit, ids = word.findall(low(t)), set(), set()
        for k, text in items:
            v = word.findall(low(text))
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        ids.add(str(k))
        want[i] = (len(w), len(hit), sorted(ids))
    for most in (winnow.PRINT_BYTES, 8):  # by tasks that hold all fingerprints, and by a join
        monkeypatch.setattr(winnow, "PRINT_BYTES", most)
        rows = winnow.mark_leaks(docs, bench).where("doc_id IS NOT NULL").collect()
        assert all((r.leak.n_words, sum(s.end_word - s.start_word for s in r.leak.spans), r.leak["items"]) == want[r.doc_id] for r in rows) and len(rows) == len(TEXTS) + 1
    assert winnow.mark_leaks(empty, bench).count() == 0
    assert all(not r.leak.spans for r in winnow.mark_leaks(docs, bench.where("false")).collect())


def test_packing(docs, empty):
    rows = packing.pack(docs, 512, 1).collect()
    ids = tokens(TEXTS + ["a null id"])
    at, used = defaultdict(list), Counter()
    for r in rows:
        whole = (ids[r.doc_id] if r.doc_id is not None else ids[-1]) + [1]
        part = whole[r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and r.start == r.piece * 512
        at[r.sequence_id].append((r.offset, r.length))
        used[r.doc_id] += r.length
    for v in at.values():
        v.sort()
        assert all(o == sum(n for _, n in v[:i]) for i, (o, _) in enumerate(v)) and sum(n for _, n in v) <= 512
    assert sum(used.values()) == sum(len(x) + 1 for x in ids) + len(ids[5]) + 1
    assert packing.pack(empty).count() == 0


def test_best_fit_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 65, rng.integers(1, 300))
        bins: list[int] = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = [b for b in bins if b >= s]
            if fit:
                bins.remove(min(fit))
                bins.append(min(fit) - s)
            else:
                bins.append(64 - s)
        assert packing.plan_best_fit(Counter(sizes.tolist()), 64)[1] == len(bins)


def test_token_counts(docs, empty):
    want = [len(x) for x in tokens(TEXTS)]
    rows = transducer.count_tokens(docs).where("doc_id IS NOT NULL").collect()
    assert all(r.tokens.n_tokens == want[r.doc_id] and r.tokens.n_bytes == len((TEXTS[r.doc_id] or "").encode()) for r in rows)
    assert transducer.count_tokens(empty).count() == 0


def test_long_pieces_are_scanned_in_chunks():
    import public_tokenizers

    c = transducer.Counter(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("thing"), 3000)), "é" * 1000, "-=" * 700]
    assert c.words(texts).tolist() == [len(x) for x in tokens(texts)]


def test_id_files(spark, docs, empty, tmp_path):
    named = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    varbyte.write_ids(named, f"file://{tmp_path}/a")
    at = 0
    for r, ids in zip(sorted(varbyte.read_ids(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.doc_id), tokens(TEXTS), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += len(ids) + 1
    varbyte.write_ids(docs, f"file://{tmp_path}/b")
    assert varbyte.read_ids(spark, f"file://{tmp_path}/b").count() == docs.count()
    varbyte.write_ids(empty, f"file://{tmp_path}/c")
    assert varbyte.read_ids(spark, f"file://{tmp_path}/c").count() == 0


def test_variable_bytes_round_trip():
    rng = np.random.default_rng(3)
    for bits, top in ((1, 16), (2, 32)):
        for n in (0, 1, 7, 8, 1000):
            v = (rng.integers(0, 1 << top, n) >> rng.integers(0, top, n)).astype(np.uint32)
            c, d = varbyte.put_values(v, bits)
            assert (varbyte.get_values(np.frombuffer(c, np.uint8), np.frombuffer(d, np.uint8), n, bits) == v).all()


def test_toxicity(spark, docs, empty):
    got = queries.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").toPandas().merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    rank, pos = held.score.rank(), int(held.toxic.sum())
    assert (rank[held.toxic == 1].sum() - pos * (pos + 1) / 2) / pos / (len(held) - pos) > 0.9
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert {r.toxicity.score < 0.7 for r in toxicity.score(docs, model).collect()} == {True}
    assert toxicity.score(empty, model).count() == 0


def test_lattice(spark, docs, empty):
    from pyspark.sql import functions as F

    rows = lattice.score(docs, F.col("doc_id") < 8).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r.score) and r.score <= 0 and np.isfinite(r.base_score) for r in rows)
    c = Counter()
    for i in [*range(8), 5]:
        c.update([*SPACED.findall(low(TEXTS[i])), None])
    total, kinds = sum(c.values()), len(c)
    for r in rows:
        if r.doc_id is not None:
            w = [*SPACED.findall(low(TEXTS[r.doc_id])), None]
            base = sum(np.log10((c[x] + 1) / (total + kinds + 1)) for x in w)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), total) and abs(base - r.base_score) < 1e-6 * abs(base) + 1e-9
    assert lattice.score(empty, F.lit(True)).count() == 0


def test_forward_recursion_sums_over_all_segmentations():
    m = lattice.lattice("piece_bpe_32k.model")
    known = {(n, h): i for n, (hs, ids) in m.tables.items() for h, i in zip(hs.tolist(), ids.tolist(), strict=True)}

    def brute(w):
        if not w:
            return 1.0
        total = np.exp(m.start[m.byte[w[0]]]) * brute(w[1:])
        for n in range(1, len(w) + 1):
            if (i := known.get((n, lattice.hash_bytes(w[:n])))) is not None:
                total += np.exp(m.start[i]) * brute(w[n:])
        return total

    words = [b"", b"the", b"reading", "né".encode()]
    assert np.allclose(m.forward(words, m.start)[0], [np.log(brute(lattice.START + w)) for w in words])


def brute_components(texts):
    sets = []
    for t in texts:
        w = SPACED.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return [(len(s), c) for s, c in zip(sets, comp, strict=True)]


def test_near_duplicates(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = np.random.default_rng(4)
    texts = list(TEXTS)
    words = BASE.split()
    for _ in range(25):  # a group around one source, some links only through others
        w = list(words)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = f"q{rng.integers(9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.near_duplicates(docs).count() == docs.count()


def test_quality(docs, empty):
    rows = quality.judge(docs).where("doc_id IS NOT NULL").collect()
    for r in rows:
        t = TEXTS[r.doc_id] or ""
        w = SPACED.findall(t)
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        often = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(often))
        assert q.base_failed == (len(w) < 50 or 100 * len(often) > 50 * len(w)) and not (q.kept and q.base_failed)
    assert len(rows) == len(TEXTS) + 1 and quality.judge(empty).count() == 0


def test_quality_ignores_copies(spark):
    """A group of copies that is most of a language moves no verdict: not by the model and not by the band."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    before = {r.doc_id: (r.quality.kept, r.quality.log_perplexity) for r in quality.judge(docs).collect()}
    one = next(r for r in docs.where("lang = 'de'").orderBy("doc_id").collect() if before[r.doc_id][0])
    copies = spark.range(500).selectExpr("-1 - id AS doc_id").crossJoin(docs.where(f"doc_id = {one.doc_id}").select("text", "lang"))
    after = {r.doc_id: (r.quality.kept, r.quality.log_perplexity) for r in quality.judge(docs.unionByName(copies)).collect()}
    assert {k: v for k, v in after.items() if k >= 0} == before and all(after[-1 - i] == before[one.doc_id] for i in range(500))


def test_quality_of_a_rare_language(spark):
    """A language's own model, and so the verdicts of its documents, don't depend on its share of the rows."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang IN ('de', 'en')")
    many = spark.range(20_000).select((-1 - F.col("id")).alias("doc_id"), F.concat(F.lit("short "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rare = docs.unionByName(many).unionByName(spark.createDataFrame([(-30_000, "uno dos tres", "es"), (-30_001, "un deux trois", "fr")], docs.schema))
    a, b = quality.train(docs), quality.train(rare)
    assert (sorted(a.orders), sorted(b.orders)) == (["+de", "+en"], ["+de", "+en", "+es", "+fr"])
    for x, y in zip(a.orders["+de"], b.orders["+de"], strict=True):
        assert all(np.array_equal(p, q) for p, q in zip(x, y, strict=True))


def brute_kneser_ney(texts):
    """log10 p(gram) of modified Kneser-Ney trigrams by its definition, over classes of characters."""
    seqs = [[0, 0, *quality.classes(*quality.buffer_of(quality.pa.array([t], quality.pa.large_string())))[0].tolist()] for t in texts]
    three = Counter(tuple(s[i - 2 : i + 1]) for s in seqs for i in range(2, len(s)))
    two, one = Counter(g[1:] for g in three), None
    one = Counter(g[1:] for g in two)
    levels = {1: one, 2: two, 3: three}
    off = {}
    for n, counts in levels.items():
        k = [0, *(sum(v == i for v in counts.values()) for i in (1, 2, 3, 4))]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0.5
        off[n] = [0, *(min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.05), i - 0.05) if k[i] else 0.5 * i for i in (1, 2, 3))]

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 128
        row = {g: v for g, v in levels[n].items() if g[:-1] == gram[:-1]}
        if not row:
            return p(gram[1:])
        total, mass = sum(row.values()), sum(off[n][min(v, 3)] for v in row.values())
        v = row.get(gram, 0)
        return (v - off[n][min(v, 3)]) / total + mass / total * p(gram[1:])

    return p, three


def test_kneser_ney_against_its_definition(spark):
    texts = ["the cat sat on the mat 12", "a Dog, a dog ÉÈ 日本", "dogs eat the hats"]
    model = quality.train(spark.createDataFrame([(t, "en") for t in [*texts, texts[0]]], "text string, lang string"))
    p, seen = brute_kneser_ney(texts)
    grams = [*seen, (5, 6, 7), (0, 0, 99), (70, 71, 3), (99, 98, 97)]
    codes = np.array([a << 14 | b << 7 | c for a, b, c in grams])
    assert np.abs(model.lookup("+en", codes) - np.log10([p(g) for g in grams])).max() < 1e-6
    for context in {g[:2] for g in grams}:
        every = (context[0] << 14 | context[1] << 7) + np.arange(128)
        assert abs((10 ** model.lookup("+en", every)).sum() - 1) < 1e-4
    arr = quality.pa.array(texts, quality.pa.large_string())
    for t, got in zip(texts, model.perplexity(arr, ["+en"] * 3), strict=True):
        c = [0, 0, *quality.classes(*quality.buffer_of(quality.pa.array([t], quality.pa.large_string())))[0].tolist()]
        assert abs(got + np.mean([np.log10(p(tuple(c[i - 2 : i + 1]))) for i in range(2, len(c))])) < 1e-6


def test_bands_are_exact_quartiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs)
    rows = {(r.lang, r.text) for r in docs.collect() if r.text.strip(" ")}
    for r in quality.bands(docs.repartition(7), model).collect():
        texts = [t for lang, t in rows if "+" + lang == r.l]
        v = np.sort(np.round(model.perplexity(quality.pa.array(texts, quality.pa.large_string()), [r.l] * len(texts)) * quality.STEPS)) / quality.STEPS
        q = [v[int(np.ceil(x * len(v))) - 1] for x in (0.25, 0.5, 0.75)]
        spread = max((q[2] - q[0]) / 2 * 1.4826, quality.LEAST / quality.UPPER)
        assert abs(r.low - (q[1] - quality.LOWER * spread)) < 2e-4 * 6 and abs(r.high - (q[1] + quality.UPPER * spread)) < 2e-4 * 6


def test_shards_under_copies(spark):
    """A thousand repeats of one row don't fall into one shard; groups that fit stay in one."""
    from pyspark.sql import functions as F

    rows = [(1, "x" * 14, "s", "en")] * 1000 + [(i, f"{i:014}", "t", "en") for i in range(100, 150)] + [(i, f"{i % 7:014}", "u", "de") for i in range(200, 214)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = kdshards.kd_shards(docs, ["source", "lang"], F.octet_length("text") + 8, leaves=24, carry=(F.col("text"),)).collect()
    size, where = Counter(), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        where[r.text].add(r.shard)
    mean = sum(size.values()) / 24
    assert len(got) == len(rows) and len(size) == 24 and max(size.values()) - min(size.values()) <= mean / 4
    assert all(len(where[f"{i:014}"]) == 1 for i in range(7))


def test_chunks_compose_from_any_entry():
    import public_tokenizers

    m = transducer.Counter(public_tokenizers.path("word_bpe_49k.json")).machine
    piece = np.frombuffer("".join(np.random.default_rng(5).choice(list("etaoin"), 2000)).encode(), np.uint8)
    a, b = m.chunk_maps(piece)[1:3]
    b = transducer.ChunkMap(b.begin, b.end, b.states[:0], b.exits[:0], b.counts[:0])  # knows no entry
    both = m.compose(piece, a, b)
    exits, counts = m.advance(piece, np.full(len(a.states), a.begin), np.full(len(a.states), b.end), a.states)
    assert (both.exits == exits).all() and (both.counts == counts).all()


def test_word_table_compares_bytes(monkeypatch):
    from millrace.llm import wordcache

    monkeypatch.setattr(wordcache, "word_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    table = wordcache.WordTable(lambda words: (np.zeros(0, np.uint32), np.array([len(x) for x in words.to_pylist()])))
    texts = ["a bb ccc a", "dddd bb", ""]
    assert table.sizes(quality.pa.array(texts, quality.pa.large_string())).tolist() == [7, 6, 0]


def test_long_words_have_the_same_lattice(monkeypatch):
    m = lattice.lattice("piece_bpe_32k.model")
    words = ["".join(np.random.default_rng(6).choice(list("etaoin"), 300)).encode()]
    one = m.forward(words, m.start, np.ones(1))
    monkeypatch.setattr(lattice, "LONG", 1 << 20)
    other = m.forward(words, m.start, np.ones(1))
    assert np.allclose(one[0], other[0]) and np.allclose(one[1], other[1])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert 0 < len({r.doc_id for r in rows}) < docs.count() and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_clashing_names_pass_through(spark, docs):
    """Columns named as the operators' own pass through, and repeated rows are handled each."""
    names = ["_low", "_high", "_lang", "_quality", "_toxicity", "_keep", "_leak", "_leak_0", "_l", "_d", "_found", "l", "d", "m"]
    odd = docs
    for n in names:
        from pyspark.sql import functions as F

        odd = odd.withColumn(n, F.lit("mine"))
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[20:34]))], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for got in (quality.keep_good(odd), toxicity.remove_toxic(odd, labels), ngram_join.keep_one(odd), winnow.remove_leaked(odd, bench)):
        assert got.columns == odd.columns and all(r[n] == "mine" for r in got.collect() for n in names)
    assert quality.judge(odd).count() == toxicity.score(odd, toxicity.Model()).count() == winnow.mark_leaks(odd, bench).count() == odd.count()


def test_few_labels_call_nothing_toxic_that_saves_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = [r.toxicity.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
    assert sum(x >= toxicity.THRESHOLD for x in got) < len(got) / 4


def test_equal_texts_get_equal_scores(spark, docs):
    got = toxicity.score(docs, toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))).collect()
    by = defaultdict(set)
    for r in got:
        by[r.text or ""].add(r.toxicity.score)
    assert len(got) == docs.count() and all(len(v) == 1 for v in by.values())


def test_pipeline_of_odd_tables(spark, docs, empty, tmp_path):
    """Nulls, empty and repeated texts go through all stages; an empty table gives no rows."""
    import corpus_pipeline

    some = spark.read.parquet(f"{SF}/documents.parquet")
    for n in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{n}.parquet").write.parquet(f"{tmp_path}/{n}.parquet")
    odd = some.unionByName(spark.createDataFrame([(None, "a null id"), (-1, None), (-2, ""), (-3, "word"), (-4, "z" * 3000)], "doc_id bigint, text string"), allowMissingColumns=True).unionByName(some.limit(5))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = corpus_pipeline.run(spark, SF).select("doc_id").distinct().count()
    assert abs(len({r.doc_id for r in rows}) - want) <= 3 and not {r.doc_id for r in rows} & {-1, -2, -3, -4}
    some.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_leaks_are_joined_without_texts(spark, tmp_path):
    """However large the hits are, the texts of the corpus are not shuffled to meet them."""
    spark.createDataFrame([(i, BASE) for i in range(5)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, BASE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = winnow.op3(spark, str(tmp_path))
        plan = [out._jdf.queryExecution().sparkPlan()]
        sides = []
        while plan:
            node = plan.pop()
            below = [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.getClass().getSimpleName():
                sides += [x.output().mkString(",") for x in below]
            plan += below
        assert len(sides) == 2 and not any("text" in x for x in sides)
        assert all(r.contaminated and r.n_words == r.n_hit for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_word_table_keeps_words_met_again(monkeypatch):
    from millrace.llm import wordcache

    monkeypatch.setattr(wordcache, "MOST", 4)
    made = []

    def make(words):
        made.append(words.to_pylist())
        n = np.array([len(x) % 3 for x in made[-1]], np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *(np.full(k, ord(x[0]), np.uint32) for k, x in zip(n, made[-1], strict=True))]), n

    table, long = wordcache.WordTable(make), "x" * 100
    for texts, new in ((["a bb ccc bb dddd", f"{long} eeeee {long}"], {"a", "bb", "ccc", "dddd", "eeeee", long}), ([f"bb {long} f a", long[1:] + "y"], {"f", "a", long[1:] + "y"})):
        made.clear()
        values, first = table.all_values(quality.pa.array(texts, quality.pa.large_string()))
        want = [[ord(w[0]) for w in t.split() for _ in range(len(w) % 3)] for t in texts]
        assert values.tolist() == sum(want, []) and first.tolist() == [0, len(want[0]), len(want[0]) + len(want[1])]
        assert set(sum(made, [])) == new and sum(map(len, made)) == len(new)


def test_plain_words_have_the_library_s_ids():
    from millrace.llm import token_ids

    texts = ["It's I'LL don't''S 'Tis ROCK'N'ROLL a1b22,c..d!", "ÀÉÎ õüß ÿÞæ naïve's Ça×÷ Öl-1990 Straße", "x", "", "«à» <|a|> <a|b> ſs 'ſ Ǆ ﬁ é", "ab" * 60 + "é." * 40]
    got, first = token_ids.encode(quality.pa.array(texts, quality.pa.large_string()))
    assert [got[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == tokens(texts)


def test_packing_encodes_little_at_once(spark, monkeypatch):
    """The arrays made of a piece of text are many times its bytes, and two tasks share an executor with the JVM."""
    sizes = []
    monkeypatch.setattr(packing, "encode", lambda arr, name: sizes.append(int(quality.pa.compute.sum(quality.pa.compute.binary_length(arr)).as_py())) or (np.zeros(0, np.uint32), np.zeros(len(arr) + 1, np.int64)))
    monkeypatch.setattr(packing, "map_arrow", lambda df, fn, schema: list(fn([quality.pa.record_batch([quality.pa.array(range(12)), quality.pa.array(["x" * 1_000_000] * 12)], names=["doc_id", "text"])])))
    packing.cut(spark.createDataFrame([], "doc_id bigint, text string"), 512, 1)
    assert sum(sizes) == 12_000_000 and max(sizes) <= 3 << 20


def test_pipeline_works_on_little_text_at_once(spark, monkeypatch):
    """A piece's arrays are up to eighty times its bytes, and two tasks share an executor with the JVM."""
    from millrace.llm import common

    pa, sizes, real = quality.pa, [], common.texts
    batch = pa.record_batch([pa.array(range(12)), pa.array(["x" * 400_000] * 12), pa.array(["x" * 400_000] * 12), pa.array(["+en"] * 12), pa.array([b"d"] * 12)], names=["id", "text", "t", "l", "d"])

    def noted(b, column="text"):
        sizes.append(int(pa.compute.sum(pa.compute.binary_length(real(b, column))).as_py()))
        return real(b, column)

    def mapped(df, fn, schema):
        list(fn([batch.select(["id", "text"]) if "text" in df.columns else batch]))
        return spark.createDataFrame([], schema)

    for module in (common, ngram_join, winnow, quality):
        monkeypatch.setattr(module, "texts", noted)
        monkeypatch.setattr(module, "map_arrow", mapped)
    docs = spark.createDataFrame([], "id bigint, text string, lang string")
    ngram_join._profile(docs)
    ngram_join._early(docs, np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    ngram_join._signed(docs)
    winnow._met_in_tasks(docs.withColumnRenamed("text", "t"), np.zeros(1, np.int64), [10])
    quality.count_grams(docs)
    toxicity.score(docs, toxicity.Model())
    assert sum(sizes) == 6 * 4_800_000 and max(sizes) <= 1_600_000


def test_pipeline_gives_python_few_rows_at_once(spark):
    import corpus_pipeline

    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.read.parquet(f"{SF}/documents.parquet")
    old = spark.conf.get(name)
    try:
        for given, want in (("10000", "512"), ("0", "512"), ("100", "100")):
            spark.conf.set(name, given)
            corpus_pipeline.STAGES[3][1](spark, docs, SF)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, old)
