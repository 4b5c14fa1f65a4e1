r"""Secret scans with DataFrame functions only.

Base kinds are patterns, found leftmost and without overlap per kind:

* `assign`: a key word, `:` or `=`, and a value of 12 characters or more,
* `access`: `AKIA` and capitals or digits, 18 characters or more,
* `hex`: 16 or more of `0-9a-f`.

The kind `entropy` finds what has no known form. Candidates are runs of 20 or more of `A-Za-z0-9+/_=-` that do not look like words;
a candidate belongs to the class hex, letters with digits, or base64 by the characters in it. A window of `WINDOW` characters slides over it; counts
per character change by the one that enters and the one that leaves, and with them the sum of `n log2 n`,
from which Shannon entropy follows at every step. Windows at or over the threshold of the class are joined into spans.
The allow list suppresses whole candidates that are UUIDs or paths, and of all others only the signs of a known harmless pattern (the
alphabet in order, long runs, EXAMPLE): a window that holds one of these signs does not count, the pieces of the candidate between
them are scanned as if they stood alone. So a secret joined to such a pattern is found. Pieces without a letter or without a digit are words or
numbers, not secrets. Entropy spans inside a base span are dropped; base spans are never suppressed.

Spans are (kind, start, end) in code points, end exclusive, ordered by start, then by kind in the order above.

Defined results: a NULL or empty text has no spans; repeated rows are scanned alike; an empty table gives an empty result; other columns
are ignored. Texts are scanned whole; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run shorter than the least length cannot match in part either, so these two ask for the length at once.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

#: A run of candidate characters, taken whole.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Characters that are counted, and the least entropy in bits per class.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = {"hex": 3.1, "mixed": 3.6, "base64": 3.7}
#: Candidates that are no secrets.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Parts of candidates that are no secrets: a published sample key, letters or digits in order, a long run of one sign, the word EXAMPLE.
IN_ORDER = r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|abcdefghij|ABCDEFGHIJ|0123456789|(.)\1{7,}|EXAMPLE"

SPAN = "array<struct<start:int,end:int>>"


def find(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of all matches of `pattern`, by the lengths of matches and of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, found, lambda g, f: F.struct(g.alias("gap"), f.alias("found")))
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("spans")
    )

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.coalesce(F.length(pair["found"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["found"].alias("found")))
        spans = F.when(pair["found"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], span))
        return F.struct(end.alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda s: s["spans"])).otherwise(none)


def pieces(candidates: Column) -> Column:
    """Array of (start, found): what is left of the candidates between parts on the allow list, if a window fits in and it may be a secret."""

    def between(c: Column) -> Column:
        # A sign that no candidate holds stands after every match, so that a match's length is known where the next piece begins.
        marked = F.split(F.regexp_replace(c["found"], IN_ORDER, " $0 "), " ", -1)
        start = F.struct(c["start"].alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("kept"))

        def step(state: Column, part: Column) -> Column:
            one = F.array(F.struct(state["at"].alias("start"), part.alias("found")))
            good = (F.length(part) >= WINDOW) & part.rlike("[0-9]") & part.rlike("[A-Za-z]") & ~part.rlike(f"^(?:{IN_ORDER})$")
            kept = F.when(good, F.concat(state["kept"], one)).otherwise(state["kept"])
            return F.struct((state["at"] + F.length(part)).alias("at"), kept.alias("kept"))

        return F.aggregate(marked, start, step, lambda s: s["kept"])

    return F.flatten(F.transform(F.filter(candidates, lambda c: ~allowed(c["found"])), between))


def entropy_windows(candidate: Column, least: Column) -> Column:
    """Array of (start, end) inside `candidate`: the union of all windows with at least `least` bits per character."""
    log2 = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    place = lambda at: F.instr(F.lit(ALPHABET), F.substr(candidate, at, F.lit(1)))
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0.0).cast("double").alias("sum"),
        F.array().cast(SPAN).alias("spans"),
    )

    def step(state: Column, at: Column) -> Column:
        enters = place(at)
        leaves = F.when(at > WINDOW, place(at - WINDOW)).otherwise(F.lit(-1))
        counts = state["counts"]
        n_in = F.get(counts, enters)
        n_out = F.coalesce(F.get(counts, leaves), F.lit(0))
        moved = F.when(
            enters == leaves, state["sum"]
        ).otherwise(
            state["sum"] + log2(n_in + 1) - log2(n_in)
            + F.when(leaves >= 0, log2(n_out - 1) - log2(n_out)).otherwise(F.lit(0.0))
        )
        changed = F.transform(
            counts,
            lambda n, i: n + F.when(i == enters, 1).otherwise(0) - F.when(i == leaves, 1).otherwise(0),
        )
        bits = F.log2(F.lit(float(WINDOW))) - moved / WINDOW
        high = (at >= WINDOW) & (bits >= least - 1e-9)
        spans = state["spans"]
        last = F.get(spans, F.size(spans) - 1)
        begin = at - WINDOW
        joined = F.concat(
            F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(F.struct(last["start"].alias("start"), at.alias("end")))
        )
        added = F.concat(spans, F.array(F.struct(begin.alias("start"), at.alias("end"))))
        touches = (F.size(spans) > 0) & (last["end"] >= begin)
        after = F.when(~high, spans).when(touches, joined).otherwise(added)
        return F.struct(changed.alias("counts"), moved.alias("sum"), after.alias("spans"))

    return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), start, step, lambda s: s["spans"])


def allowed(candidate: Column) -> Column:
    """On the allow list as a whole: UUIDs, words or numbers only, and paths of short parts."""
    path = candidate.contains("/") & ~candidate.rlike("[^/]{13}")
    return candidate.rlike(UUID) | ~candidate.rlike("[0-9]") | ~candidate.rlike("[A-Za-z]") | path


def threshold(candidate: Column) -> Column:
    """Least entropy of the character class of a candidate's piece."""
    return (
        F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(LEAST["hex"]))
        .when(candidate.rlike("^[A-Za-z0-9]+$"), F.lit(LEAST["mixed"]))
        .otherwise(F.lit(LEAST["base64"]))
    )


def scan(docs: DataFrame) -> DataFrame:
    """`doc_id` and `spans`, an array of (start, rank, end) in order, `rank` into `KINDS`; `docs` has `doc_id`, `text`."""
    text = F.coalesce("text", F.lit(""))
    located = docs.select(
        "doc_id",
        F.filter(
            find(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 12
        ).alias("assign"),
        find(text, ACCESS).alias("access"),
        find(text, HEX).alias("hex"),
        pieces(find(text, CANDIDATE)).alias("candidate"),
    )
    windows = F.flatten(
        F.transform(
            "candidate",
            lambda c: F.transform(
                entropy_windows(c["found"], threshold(c["found"])),
                lambda w: F.struct((c["start"] + w["start"]).alias("start"), (c["start"] + w["end"]).alias("end")),
            ),
        )
    )
    ranked = lambda spans, rank: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))
    )
    based = located.select(
        "doc_id",
        F.concat(*(ranked(F.col(kind), rank) for rank, kind in enumerate(KINDS[:3]))).alias("base"),
        ranked(windows, 3).alias("entropy"),
    )
    inside = lambda e: F.exists("base", lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"]))
    return based.select("doc_id", F.array_sort(F.concat("base", F.filter("entropy", lambda e: ~inside(e)))).alias("spans"))


def written(spans: Column) -> Column:
    """`kind:start:end` of all spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
