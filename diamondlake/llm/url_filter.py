"""URL filter: wildcard rules packed into multiword Shift-And masks.

Every rule and glob becomes a run of bits, one for its start and one for each byte it must read; a ``*`` is a
self-loop on the bit before it. All patterns advance together, one byte of every canonical URL at a time, with the
shift's carry passed between 64-bit words. A canonical URL is ``.host``, the byte 0xFF (in no UTF-8 text), ``path``.

Defined results: a null url, or one without ``://``, has empty host and path and is judged like any other; repeated
rows come back as often; an empty table gives an empty result; other columns are ignored; a long url only lengthens
its own block. ``?`` in a glob stands for one byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

STAR, ANY, MARK = -1, -2, 0xFF
#: Bytes of the padded block that is simulated at once.
BLOCK_BYTES = 1 << 22

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: (host glob, path glob) that block a url which no rule fits.
GLOBS = (
    ("*", "*/wp-admin/*"),
    ("*", "*/cgi-bin/*"),
    ("*", "*.exe"),
    ("*", "*.zip"),
    ("ads.*", "*"),
    ("*.ads.*", "*"),
)


def rule_tokens(host: str, path: str) -> list[int]:
    """A rule fits its host, every subdomain, and every path that starts with its own."""
    return [STAR, *b".", *host.encode(), MARK, *path.encode(), STAR]


def glob_tokens(host: str, path: str) -> list[int]:
    def side(text: str) -> list[int]:
        return [{ord("*"): STAR, ord("?"): ANY}.get(b, b) for b in text.encode()]

    return [ord("."), *side(host), MARK, *side(path)]


class ShiftAnd:
    """All patterns as one bit-parallel automaton over bytes; a pattern matches a whole string."""

    def __init__(self, patterns: Sequence[Sequence[int]]):
        bits = sum(1 + sum(t != STAR for t in p) for p in patterns)
        words = max(1, -(-bits // 64))
        self.reads = np.zeros((256, words), np.uint64)
        self.loops = np.zeros(words, np.uint64)
        self.start = np.zeros(words, np.uint64)
        self.accept = []
        at = -1
        for p in patterns:
            at += 1
            self._set(self.start, at)
            for t in p:
                if t == STAR:
                    self._set(self.loops, at)
                    continue
                at += 1
                for row in self.reads if t == ANY else self.reads[t : t + 1]:
                    self._set(row, at)
            self.accept.append(at)

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << (bit % 64))

    def _run(self, block: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """block: rows by falling length. The state words of each row after its last byte."""
        state = np.repeat(self.start[None, :], len(lengths), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = np.searchsorted(-lengths, -np.arange(block.shape[1]), side="left")
        for i, n in enumerate(live):
            d = state[:n]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:n] = (moved & self.reads[block[:n, i]]) | (d & self.loops)
        return state

    def match(self, strings: Sequence[bytes]) -> np.ndarray:
        """bool[string, pattern]."""
        out = np.zeros((len(strings), len(self.accept)), bool)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(-lengths, kind="stable")
        words, shift = np.array(self.accept) // 64, np.array(self.accept, np.uint64) % np.uint64(64)
        at = 0
        while at < len(order):
            width = max(1, int(lengths[order[at]]))
            rows = order[at : at + max(1, BLOCK_BYTES // width)]
            flat = np.frombuffer(b"".join(strings[i].ljust(width, b"\0") for i in rows), np.uint8)
            state = self._run(flat.reshape(len(rows), width)[:, : int(lengths[rows[0]])], lengths[rows])
            out[rows] = (state[:, words] >> shift) & np.uint64(1)
            at += len(rows)
        return out


def filter_urls(pages: DataFrame, rules=RULES, globs=GLOBS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row. The rule with most bytes wins; where none fits, a glob blocks."""
    ranked = sorted(range(len(rules)), key=lambda i: -len((rules[i][1] + rules[i][2]).encode()))
    automaton = ShiftAnd([rule_tokens(*rules[i][1:]) for i in ranked] + [glob_tokens(*g) for g in globs])
    names = [rules[i][1] + rules[i][2] for i in ranked] + [None]
    verdicts = [rules[i][0] for i in ranked]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            hit = automaton.match([b"." + h.encode() + b"\xff" + p.encode() for h, p in zip(hosts, paths, strict=True)])
            fits, blocked = hit[:, : len(ranked)], hit[:, len(ranked) :].any(axis=1)
            first = np.where(fits.any(axis=1), fits.argmax(axis=1) if len(ranked) else 0, len(ranked))
            said = [verdicts[i] if i < len(ranked) else "block" if x else "allow" for i, x in zip(first, blocked, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([names[i] for i in first], pa.string()), pa.array(said, pa.string())],
                [*b.schema.names, "rule", "verdict"],
            )

    start = F.instr("url", "://")
    rest = F.when(start > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = pages.select(
        "page_id",
        F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    out = f"page_id {dict(parts.dtypes)['page_id']}, host string, path string, rule string, verdict string"
    return parts.mapInArrow(judge, out)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN path LIKE '%/wp-admin/%' OR path LIKE '%/cgi-bin/%' OR path LIKE '%.exe' OR path LIKE '%.zip'
      OR host LIKE 'ads.%' OR host LIKE '%.ads.%' THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
