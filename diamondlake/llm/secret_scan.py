"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans are regular-expression matches, per kind leftmost and not overlapping. The method adds weak spans (account
identifiers, opaque tokens, endpoints), each of which counts only when parts that complete it lie in the same scope,
the text between two blank lines: an interval join inside the row, so nothing is shuffled. Spans and breaks are merged
by their start, and running maxima say what lies between the breaks around a span, so the work grows with the number
of spans, not with its square.

Defined results: null or empty text has no span; repeated rows come back as often; an empty table gives an empty
result; other columns are ignored (``scan``) or passed through (``redacted``). Positions count code points, the end is
exclusive. Letters are folded for A-Z only. Line ends are LF, CR LF or CR; a text without a blank line is
one scope.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, unused_name

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The shortest length is part of the next two patterns: each match is a whole run, or the rest of one.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"""(?i)(?:client_?id|user_?name|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}+"
ENDPOINT = r"""(?i)\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+"""
#: An endpoint with a user and a password is complete by itself.
USER_AND_PASSWORD = r"^[^:]+://[^/@:]+:[^/@]+@"
BREAK = r"(?>\r\n|\r|\n)[\x20\t]*+(?>\r\n|\r|\n)"

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "opaque", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENTIFIER, OPAQUE, ENDPOINT), strict=True)) | {"break": BREAK}
#: What completes what: a part that says who, and a part that is secret. A linked span needs those of the other sort.
WHO, SECRET = ("access", "identifier"), ("assign", "opaque")
#: What ``redacted`` leaves: who an account belongs to is no secret.
SHOWN = ("identifier",)
PLACE = {k: i for i, k in enumerate([*KINDS, "break"])}
SPAN = "array<struct<start:int,kind:int,stop:int,whole:boolean>>"
#: Elements that a running sum or maximum reads at a time.
STRETCH = 64
#: Code points of a text that are searched for a place in it.
BLOCK = 2048


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is read inside."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, joined: Callable[[Column], Column], least: Column) -> Column:
    """For each element what ``joined`` makes of the elements up to it. Stretches are joined first, then those before a
    stretch, so an element reads the elements of its stretch only."""

    def of(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int"))
        sums = F.transform(places, lambda c: joined(F.slice(v, c * STRETCH + 1, F.lit(STRETCH))))
        before = _let(sums, lambda s: F.transform(places, lambda c: F.when(c > 0, joined(F.slice(s, F.lit(1), c))).otherwise(least)))

        stretch = lambda i: F.floor(i / STRETCH).cast("int")
        own = lambda i: joined(F.slice(v, stretch(i) * STRETCH + 1, i % STRETCH + 1))
        return _let(before, lambda b: F.transform(v, lambda x, i: joined(F.array(F.get(b, stretch(i)), own(i)))))

    return F.when(F.size(values) > 0, _let(values, of)).otherwise(F.array().cast("array<int>"))


def _running_sum(values: Column) -> Column:
    return _running(values, lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y), F.lit(0))


def _running_max(values: Column, least: int = -1) -> Column:
    return _running(values, F.array_max, F.lit(least))


def _coming_min(values: Column, most: int = (1 << 31) - 1) -> Column:
    """For each element the least one from it on."""
    return F.transform(F.reverse(_running_max(F.transform(F.reverse(values), lambda x: -x), -most)), lambda x: -x)


def _located(text: Column, found: Column, kind: str) -> Column:
    """Matches with their places: the pieces between matches give the distances."""
    hits = F.arrays_zip(F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    whole = (lambda hit: hit.rlike(USER_AND_PASSWORD)) if kind == "endpoint" else (lambda hit: F.lit(False))

    def placed(pairs: Column) -> Column:
        stops = _running_sum(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"])))
        row = lambda p, stop: F.struct(
            (stop - F.length(p["hit"])).alias("start"), F.lit(PLACE[kind]).alias("kind"), stop.alias("stop"), whole(p["hit"]).alias("whole")
        )
        spans = F.zip_with(pairs, stops, row)
        if kind != "assign":
            return spans
        long = F.transform(pairs, lambda p: F.length(F.regexp_extract(p["hit"], ASSIGN, 2)) >= 6)
        both = F.arrays_zip(spans.alias("span"), long.alias("long"))
        return F.transform(F.filter(both, lambda x: x["long"]), lambda x: x["span"])

    return F.when(F.size(found) > 0, _let(hits, placed)).otherwise(F.array()).cast(SPAN)


def _is(x: Column, names: tuple[str, ...]) -> Column:
    return x["kind"].isin([PLACE[n] for n in names])


def _disjoint(spans: Column) -> Column:
    """Sorted spans without the weak ones that overlap a base span, which say nothing new."""

    def kept(s: Column) -> Column:
        ended = _running_max(F.transform(s, lambda x: F.when(_is(x, BASE), x["stop"]).otherwise(-1)))
        begins = _coming_min(F.transform(s, lambda x: F.when(_is(x, BASE), x["start"]).otherwise((1 << 31) - 1)))
        rows = F.arrays_zip(s.alias("span"), ended.alias("ended"), begins.alias("begins"))
        free = lambda r: (r["ended"] <= r["span"]["start"]) & (r["begins"] >= r["span"]["stop"])
        return F.transform(F.filter(rows, lambda r: _is(r["span"], BASE) | free(r)), lambda r: r["span"])

    return _let(spans, kept)


def _linked(spans: Column, breaks: Column) -> Column:
    """Base spans, and the weak ones that the parts between the breaks around them complete."""

    def kept(s: Column) -> Column:
        def near(names: tuple[str, ...]) -> Column:
            """Whether a part of these kinds lies between the breaks, by the last and next place of either."""
            last = lambda kinds: _running_max(F.transform(s, lambda x, i: F.when(_is(x, kinds), i).otherwise(-1)))
            far = (1 << 31) - 1
            coming = lambda kinds: _coming_min(F.transform(s, lambda x, i: F.when(_is(x, kinds), i).otherwise(far)))
            behind = F.zip_with(last(names), last(("break",)), lambda a, b: a > b)
            ahead = F.zip_with(coming(names), coming(("break",)), lambda a, b: a < b)
            return F.zip_with(behind, ahead, lambda a, b: a | b)

        rows = F.arrays_zip(s.alias("span"), near(WHO).alias("who"), near(SECRET).alias("secret"))

        def counts(r: Column) -> Column:
            x = r["span"]
            return (
                _is(x, BASE) | (_is(x, ("identifier",)) & r["secret"]) | (_is(x, ("opaque",)) & r["who"])
                | (_is(x, ("endpoint",)) & (x["whole"] | (r["who"] & r["secret"])))
            )

        return F.transform(F.filter(rows, counts), lambda r: r["span"])

    return _let(F.array_sort(F.concat(spans, breaks)), kept)


def with_spans(docs: DataFrame, base: str, every: str) -> DataFrame:
    """``docs`` and two array columns, of base spans and of all spans, each by start and then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = docs.select(row, F.struct(*[F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)).alias(k) for k in KINDS]).alias("f"))
    own = F.coalesce(F.col("row")["text"], F.lit(""))
    weak = reduce(lambda a, b: a | b, [F.size(F.col(f"f.{k}")) > 0 for k in KINDS[3:]])
    spans = F.array_sort(F.concat(*[_located(own, F.col(f"f.{k}"), k) for k in KINDS]))
    placed = found.select("row", weak.alias("weak"), spans.alias("s"))
    breaks = _located(F.coalesce(F.col("row")["text"], F.lit("")), F.regexp_extract_all(F.coalesce(F.col("row")["text"], F.lit("")), F.lit(BREAK), F.lit(0)), "break")
    all_of = F.when(F.col("weak"), _linked(_disjoint(F.col("s")), breaks)).otherwise(F.col("s"))
    return placed.select("row", F.filter("s", lambda x: _is(x, BASE)).alias(base), all_of.alias(every)).select("row.*", base, every)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per row."""
    spanned = with_spans(docs.select("doc_id", "text"), "base", "every")
    of = lambda kind: F.filter("base", lambda s: _is(s, (kind,)))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return spanned.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("every")).alias("spans"))


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """Code points from ``start`` up to ``stop`` of a text cut in blocks: only the blocks at the ends are searched."""
    first, last = (F.floor(x / BLOCK).cast("int") for x in (start, stop))
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    ends = (F.substring(F.get(blocks, first), start % BLOCK + 1, F.lit(BLOCK)), F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), stop % BLOCK))
    return F.when(first == last, F.substring(F.get(blocks, first), start % BLOCK + 1, stop - start)).otherwise(F.concat(ends[0], inner, ends[1]))


def redacted(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span reported, but for identifiers, replaced in ``text``; rows and other columns stay as they
    are. Spans that overlap are replaced together."""
    base, every = (unused_name(docs.columns, k) for k in ("base", "every"))
    spanned = with_spans(docs, base, every)
    hidden = F.filter(F.col(every), lambda s: ~_is(s, SHOWN))

    places = F.sequence(F.lit(0), F.floor(F.length("text") / BLOCK).cast("int"))
    blocks = F.transform(places, lambda c: F.substring(F.col("text"), c * BLOCK + 1, F.lit(BLOCK)))

    def masked(x: Column) -> Column:
        spans, ends, cut = x["spans"], x["ends"], x["blocks"]
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        part = lambda s, i: F.when(s["start"] >= before(i), F.concat(_between(cut, before(i), s["start"]), F.lit(mask))).otherwise("")
        rest = _between(cut, F.array_max(ends), F.length("text"))
        return F.concat(F.array_join(F.transform(spans, part), ""), rest)

    ends = lambda s: _running_max(F.transform(s, lambda x: x["stop"]))
    whole = _let(hidden, lambda s: _let(F.struct(s.alias("spans"), ends(s).alias("ends"), blocks.alias("blocks")), masked))
    text = F.when(F.size(hidden) > 0, whole).otherwise(F.col("text"))
    return spanned.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
