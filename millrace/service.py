"""The engine as a library, an HTTP service and a command line: ask, link, check a statement, show the schema and the policy.

    python -m millrace.service FOLDER ask "1996년 주문 건수는"
    python -m millrace.service FOLDER serve 8000
"""

from __future__ import annotations

import json
import sys
import threading
import time
from collections import Counter
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .language import compiler, question
from .operators import governance, linking
from .plans.guard import Guard, Policy, capped
from .plans.intent import classify
from .registry import Tables

#: Requests that run at once, and seconds that one waits for its turn.
RUNNING, PATIENCE = 4, 8.0


class Busy(Exception):
    """All places are taken."""


class Engine:
    def __init__(self, spark: SparkSession, folder: str, policy: Policy | None = None, today: date | None = None):
        self.spark, self.folder, self.policy, self.today = spark, folder, policy or governance.policy(), today
        self.gate, self.counts = threading.BoundedSemaphore(RUNNING), Counter()

    def guard(self, context: dict | None = None) -> Guard:
        return Guard(self.spark, self.folder, self.policy, context, governance.NAMES)

    def _answered(self, v, told: dict) -> dict:
        if not v.allowed:
            self.counts["blocked"] += 1
            return told | {"status": "blocked", "violations": v.violations}
        rows, more = capped(v.result, self.policy.cap)
        self.counts["ok"] += 1
        return told | {"status": "ok", "columns": v.result.columns, "rows": [list(r) for r in rows], "truncated": more, "rewrites": v.rewrites}

    def query(self, sql: str, context: dict | None = None) -> dict:
        """The rows of a statement under the policy."""
        if not self.gate.acquire(timeout=PATIENCE):
            raise Busy
        try:
            return self._answered(self.guard(context).check(sql), {"sql": sql})
        finally:
            self.gate.release()

    def ask(self, text: str, context: dict | None = None) -> dict:
        """The answer to a question in words; requests for changes or for data that may not be given out are refused."""
        forbidden = {c.split(".")[1] for c, g in self.policy.grades.items() if g == "forbidden"}
        intent = classify(text, set(compiler.TABLES), forbidden)
        if intent.kind != "read":
            self.counts["blocked"] += 1
            return {"status": "blocked", "violations": [(f"INTENT_{intent.kind.upper()}", "block", ", ".join(map(str, intent.matched)))]}
        if not self.gate.acquire(timeout=PATIENCE):
            raise Busy
        try:
            p = compiler.plan(question.understand(text, self.today or date.today()))
            g = self.guard(context)
            try:
                df = compiler.lower(p, g.spark.table)
            except ValueError as e:
                return {"status": "clarify", "message": str(e)}
            got = self._answered(g.inspect(df), {"plan": p.__dict__})
            if got["status"] == "ok":
                got["answer"] = compiler.answer(p, [dict(zip(got["columns"], r, strict=True)) if not (p.dimensions or p.buckets) else _Row(got["columns"], r) for r in got["rows"]])
            return got
        finally:
            self.gate.release()

    def link(self, text: str) -> dict:
        tables, fields = linking.link(text)
        return {"tables": tables, "columns": [f"{f.table}.{f.column}" for f in fields]}

    def check(self, sql: str, context: dict | None = None) -> dict:
        v = self.guard(context).check(sql)
        return {"allowed": v.allowed, "violations": v.violations, "rewrites": v.rewrites}

    def schema(self) -> dict:
        t = Tables(self.spark, self.folder)
        return {n: [{"name": c, "type": k, "grade": self.policy.grade(n, c)} for c, k in getattr(t, n).dtypes] for n in governance.NAMES}

    def policy_summary(self) -> dict:
        return {"grades": Counter(self.policy.grades.values()), "limits": {"limit": self.policy.limit, "cap": self.policy.cap, "width": self.policy.width}, "row_policies": [r.name for r in self.policy.rows], "k": self.policy.k}

    def health(self) -> dict:
        return {"status": "ok", "requests": dict(self.counts)}


class _Row(tuple):
    """A row whose last value is also found by name."""

    def __new__(cls, names, values):
        out = super().__new__(cls, values)
        out.names = names
        return out

    def __getitem__(self, key):
        return super().__getitem__(self.names.index(key) if isinstance(key, str) else key)


def handler(engine: Engine):
    posts = {"/v1/query": lambda b: engine.ask(b["question"], b.get("context")), "/v1/sql": lambda b: engine.query(b["sql"], b.get("context")), "/v1/link": lambda b: engine.link(b["question"]), "/v1/policy/check": lambda b: engine.check(b["sql"], b.get("context"))}
    gets = {"/v1/policy": engine.policy_summary, "/v1/schema": engine.schema, "/health": engine.health, "/metrics": engine.health}

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):  # noqa: N802
            made = gets.get(self.path)
            self._send(200, made()) if made else self._send(404, {"error": "no such path"})

        def do_POST(self):  # noqa: N802
            made = posts.get(self.path.removesuffix("/stream"))
            if not made:
                return self._send(404, {"error": "no such path"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if self.path.endswith("/stream"):
                    return self._stream(made, body)
                self._send(200, made(body))
            except (KeyError, ValueError) as e:
                self._send(400, {"error": f"bad request: {e}"})
            except Busy:
                self._send(429, {"error": "busy"})

        def _stream(self, made, body) -> None:
            """Stages of a request as server-sent events."""
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream; charset=utf-8")
            self.end_headers()
            say = lambda kind, data: self.wfile.write(f"event: {kind}\ndata: {json.dumps(data, ensure_ascii=False, default=str)}\n\n".encode())
            say("started", {"at": time.time()})
            say("result", made(body))

        def log_message(self, *args) -> None:
            pass

    return Handler


def main(args: list[str]) -> int:
    folder, command, rest = args[0], args[1], args[2:]
    engine = Engine(SparkSession.builder.getOrCreate(), folder)
    if command == "serve":
        ThreadingHTTPServer(("127.0.0.1", int(rest[0]) if rest else 8000), handler(engine)).serve_forever()
    made = {"ask": lambda: engine.ask(" ".join(rest)), "sql": lambda: engine.query(" ".join(rest)), "link": lambda: engine.link(" ".join(rest)), "check": lambda: engine.check(" ".join(rest)), "schema": engine.schema, "policy": engine.policy_summary}.get(command)
    if not made:
        print(__doc__)
        return 2
    got = made()
    print(json.dumps(got, ensure_ascii=False, indent=1, default=str))
    return 0 if got.get("status", "ok") == "ok" else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
