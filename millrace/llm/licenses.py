"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case; lines that are copyright notices dropped, but not lines of a licence's
body that begin with the word; equivalent spellings made one; everything but letters and digits one space) and its SHA-256
is hash-joined to the digests of known licences. Whole texts are compared, never parts; the same is done for each line on its
own, against known one-line notices, however long the line is.

Null texts have no digest and match nothing; texts without letters or digits have the digest of '' and match nothing.
Repeated rows are scanned each. If several licences share a digest the least id is given. An empty table gives no rows. Extra columns pass
through, whatever their names, but for those of the results' names. A text takes a few times its bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Public licence texts and notices, with their SPDX ids.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{0}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
LICENSES = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC_BODY.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("ISC", "ISC License\n\n" + ISC_BODY.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", ISC_BODY.format("")),
    ("0BSD", "Zero-Clause BSD\n\n" + ISC_BODY.format("")),
]
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
]
#: Spellings that count as the same, as whole words after lower-casing.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("organisation", "organization"), ("favour", "favor"), ("https", "http")]
COPYRIGHT_LINE = r"(^|\n)[^\n\p{L}]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by[ \t])|\(c\)[ \t]*(copyright[ \t]*)?[0-9]|©)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"
#: Digests of the canonical forms of longer public licence texts, as their stewards publish them.
DIGESTS = [
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Artistic-1.0", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd"),
    ("GFDL-1.3", "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "42b67f6c2a10d2b6cb4c48a2c1a454953ad6d664174e0493c9d92e45feb4b408"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    for a, b in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return F.trim(F.regexp_replace(out, OTHER, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """digest and license_id, one row for each digest."""
    rows = spark.createDataFrame(texts, "id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("id").alias("license_id")).where(F.col("digest") != F.sha2(F.lit(""), 256))


def all_digests(spark: SparkSession) -> DataFrame:
    """The digests of LICENSES and DIGESTS."""
    rows = known_digests(spark, LICENSES)
    return rows.unionByName(spark.createDataFrame([(d, i) for i, d in DIGESTS], "digest string, license_id string")) if DIGESTS else rows


def scan(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """docs with `digest` and `license_id` of the whole text, in place of any columns of these names. Spark picks the join by the table's size."""
    return docs.withColumn("digest", digest(F.col(text))).drop("license_id").join(known, "digest", "left")


def marks(known: list[tuple[str, str]]) -> list[str] | None:
    """Words of which a line must hold one, in lower case, to be any of the notices; None if some notice has no such word.

    Each notice gives its longest word that no spelling changes, as canonical forms keep such words as they are.
    """
    changed = {w for pair in SPELLINGS for x in pair for w in re.findall(r"\w+", x)}
    out = set()
    for _, said in known:
        own = [w for w in re.findall(r"[a-z]+", said.lower()) if w not in changed]
        if not own:
            return None
        out.add(max(own, key=lambda w: (len(w), w)))
    return sorted(out)


def notices(docs: DataFrame, known: list[tuple[str, str]], into: str = "notice_ids", text: str = "text") -> DataFrame:
    """docs with the licences that some line of the text is a notice of, sorted and comma-joined ('' for none)."""
    rows = known_digests(docs.sparkSession, known).collect()  # the list's own length at most
    table_ = F.create_map(*[F.lit(x) for r in rows for x in (r.digest, r.license_id)])
    words = marks(known)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    if words is not None:
        lines = F.filter(lines, lambda x: F.lower(x).rlike("|".join(words)))
    ids = F.filter(F.transform(lines, lambda x: F.try_element_at(table_, digest(x))), lambda x: x.isNotNull())
    return docs.withColumn(into, F.array_join(F.array_sort(F.array_distinct(ids)), ","))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = notices(table(spark, sf_dir, "documents").select("doc_id", "text"), NOTICES)
    return scan(docs, all_digests(spark)).select("doc_id", "digest", "license_id", "notice_ids")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_digest(x: str) -> str:
    out = f"regexp_replace(lower({x}), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    for a, b in SPELLINGS:
        out = f"regexp_replace({out}, {_quoted(rf'\b{a}\b')}, {_quoted(b)}, 'g')"
    return f"sha256(trim(regexp_replace({out}, {_quoted(OTHER)}, ' ', 'g')))"


def _sql_known(texts: list[tuple[str, str]]) -> str:
    return f"SELECT {_sql_digest('t')} AS digest, min(id) AS license_id FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in texts)}) AS v(id, t) GROUP BY 1"


_SQL_DIGESTS = f"SELECT * FROM (VALUES {', '.join(f'({_quoted(d)}, {_quoted(i)})' for i, d in DIGESTS)}) AS d(digest, license_id)"
OP1_SQL = f"""
WITH known AS (({_sql_known(LICENSES)}) UNION ALL {_SQL_DIGESTS}), notice AS ({_sql_known(NOTICES)}),
lines AS (SELECT DISTINCT doc_id, {_sql_digest('line')} AS digest
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(lower(line), '{"|".join(marks(NOTICES) or [""])}')),
found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM lines JOIN notice USING (digest) GROUP BY doc_id)
SELECT doc_id, d.digest, license_id, coalesce(ids, '') AS notice_ids
FROM (SELECT doc_id, {_sql_digest('text')} AS digest FROM documents) AS d
LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)
"""
