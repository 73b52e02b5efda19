"""Conversations damaged by a rule, and repaired by generalised LR parsing of their roles.

Rows go by turn, nulls first; rows that share a turn go by the XXH64 of role and text. A null id is a conversation of
its own, a null turn, role or text counts as one space. The initial of a role is its first character; an empty role has
none and is neither system, user nor assistant.

Conversations lie in segments (``segments``). Whole ones are judged, parsed and rendered where they are. Of the others
first places of (role, text) are found by hash and place; their letters, a byte for each row and so no longer than the
audit, are parsed together, and texts stay in segments: a digest reads them in order, one at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.base import add_columns, column, settle
from caseloom.llm.lr import Renderer, Repairer
from caseloom.llm.segments import SEGMENT_BYTES, SEGMENT_ROWS, packed, streamed_sha256

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
PLACE = ["part", "seq"]


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, live): dropped rows stay with ``live`` false and no text, so that no id is lost."""
    name = F.concat_ws(":", *[F.coalesce(column(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)])
    rows = df.select(
        column(conv_id).alias("conv_id"), column(turn).alias("turn"), F.coalesce(column(role), F.lit(" ")).alias("role"),
        F.coalesce(column(text), F.lit(" ")).alias("text"), F.pmod(F.crc32(name.cast("binary")), F.lit(20)).alias("fault"),
    )
    fault = F.col("fault")
    text_now = F.when(fault <= 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text_now.alias("text"),
        (fault != 0).alias("live"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def judge(live: list[bool], turns: list, roles: list[str], texts: list[str], firsts: set[int] | None = None) -> tuple:
    """Letters for the parser, counts of faults, and what joins a segment to its neighbours, over live rows.

    ``firsts`` holds the places where (role, text) is seen first; None: found here.
    """
    seen: set = set()
    letters, blank, duplicate, truncated, illegal, before = [], 0, 0, 0, 0, None
    for i, (alive, role, text) in enumerate(zip(live, roles, texts, strict=True)):
        if not alive:
            continue
        initial = role[:1]
        illegal += before is not None and before + initial not in LEGAL
        before = initial
        end = text.rstrip(BLANKS)
        again = (role, text) in seen if firsts is None else i not in firsts
        if firsts is None:
            seen.add((role, text))
        if not end:
            blank += 1
            letters.append("-")
        elif again:
            duplicate += 1
            letters.append("-")
        else:
            letter = initial if initial and initial in "sua" else "x"
            if end[-1] not in ".!?":
                truncated += 1
                letter = letter.upper()
            letters.append(letter)
    known = [t for t, alive in zip(turns, live, strict=True) if alive and t is not None]
    initials = [r[:1] for r, alive in zip(roles, live, strict=True) if alive]
    return "".join(letters), blank, duplicate, truncated, illegal, known, initials


def gaps_of(least, most, distinct: int) -> int:
    return int(most) - int(least) + 1 - distinct if distinct else 0


def _whole(segments: DataFrame) -> DataFrame:
    def make():
        parser = Repairer()

        def compute(live, turns, roles, texts):
            out = [[] for _ in range(8)]
            for row in zip(live.to_pylist(), turns.to_pylist(), roles.to_pylist(), texts.to_pylist(), strict=True):
                letters, *counts, known, _ = judge(*row)
                cost, edits = parser.repair(letters)
                alive = [i for i, x in enumerate(row[0]) if x]
                lines = Renderer().lines(edits, [row[2][i] for i in alive], [row[3][i] for i in alive])
                gaps = gaps_of(known[0], known[-1], len(set(known))) if known else 0
                made = [gaps, *counts, cost, "".join(edits), hashlib.sha256("\n".join(lines).encode()).hexdigest()]
                for values, value in zip(out, made, strict=True):
                    values.append(value)
            return out

        return compute

    return add_columns(segments, [F.col(c) for c in ("live", "turns", "roles", "texts")], RESULT, make, ["key"])


def _first_places(segments: DataFrame) -> DataFrame:
    """(part, seq, firsts): the places in each segment where a (role, text) of the conversation is seen first."""
    rows = segments.select("key", *PLACE, F.posexplode(F.arrays_zip("live", "h1", "h2")).alias("i", "row")).filter("row.live")
    first = rows.groupBy("key", "row.h1", "row.h2").agg(F.min(F.struct(*PLACE, "i")).alias("first"))
    return first.select("first.*").groupBy(*PLACE).agg(F.collect_list("i").alias("firsts"))  # at most a segment's rows


def _letters(segments: DataFrame) -> DataFrame:
    """A row for each segment: its letters, counts, and the turns and initials at its ends."""
    ddl = "letters string, blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long, head string, tail string"

    def make():
        def compute(live, turns, roles, texts, firsts):
            out = [[] for _ in range(10)]
            for live_, turns_, roles_, texts_, firsts_ in zip(*(c.to_pylist() for c in (live, turns, roles, texts, firsts)), strict=True):
                letters, *counts, known, initials = judge(live_, turns_, roles_, texts_, set(firsts_ or ()))
                ends = [known[0], known[-1]] if known else [None, None]
                row = [letters, *counts, len(set(known)), *ends, *([initials[0], initials[-1]] if initials else [None, None])]
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            return out

        return compute

    return add_columns(segments, [F.col(c) for c in ("live", "turns", "roles", "texts", "firsts")], ddl, make, ["key", *PLACE])


def _parsed(letters: DataFrame) -> DataFrame:
    """For each conversation its totals, audit and, for each segment, edits and how many lines stand before it."""
    ordered = Window.partitionBy("key").orderBy(*PLACE)
    # neighbours' ends: the last turn and initial of any segment before
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = letters.withColumn("high_before", F.max("high").over(before)).withColumn("tail_before", F.last("tail", True).over(before))
    joint = F.col("tail_before").isNotNull() & F.col("head").isNotNull() & ~F.concat("tail_before", "head").isin(*LEGAL)
    rows = rows.withColumn("illegal", F.col("illegal") + joint.cast("long"))
    rows = rows.withColumn("n_turns", F.col("n_turns") - F.coalesce((F.col("low") == F.col("high_before")).cast("long"), F.lit(0)))
    totals = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")]
    joined = rows.groupBy("key").agg(
        *totals, F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(F.struct(*PLACE, "letters"))).alias("s"),
    )
    gaps = F.when(F.col("n_turns") > 0, F.col("high") - F.col("low") + 1 - F.col("n_turns")).otherwise(0)
    joined = joined.withColumn("gaps", gaps.cast("long"))

    def make():
        parser = Repairer()

        def compute(segments):
            costs, audits, places = [], [], []
            for parts in segments.to_pylist():
                letters = "".join(p["letters"] for p in parts)
                cost, edits = parser.repair(letters)
                at, given, cuts, lines = 0, 0, [], 0
                for k, p in enumerate(parts):
                    n = len(p["letters"])
                    here = edits[at : at + n] + (edits[-1:] if k == len(parts) - 1 else [])
                    cuts.append({"part": p["part"], "seq": p["seq"], "edits": here, "given": given, "before": lines})
                    kept = sum(len(e) - e.count("D") for e in here)
                    # a system line is kept by K and gives no role
                    system = sum(e[-1:] == "K" and letters[at + j : at + j + 1].lower() == "s" for j, e in enumerate(here))
                    given, lines, at = given + kept - system, lines + kept, at + n
                costs.append(cost)
                audits.append("".join(edits))
                places.append(cuts)
            return [costs, audits, places]

        return compute

    ddl = "cost long, audit string, places array<struct<part:int,seq:int,edits:array<string>,given:long,before:long>>"
    return add_columns(joined, [F.col("s")], ddl, make, ["key", "gaps", "blank", "duplicate", "truncated", "illegal"])


def _rendered(segments: DataFrame, parsed: DataFrame) -> DataFrame:
    """(key, part, seq, piece): what each segment adds to the repaired text."""
    places = parsed.select(F.explode("places").alias("p")).select("p.*")

    def make():
        def compute(live, roles, texts, edits, given, before):
            out = []
            for live_, roles_, texts_, edits_, given_, before_ in zip(*(c.to_pylist() for c in (live, roles, texts, edits, given, before)), strict=True):
                alive = [i for i, x in enumerate(live_) if x]
                lines = Renderer(given_).lines(edits_, [roles_[i] for i in alive], [texts_[i] for i in alive])
                out.append((b"\n" if before_ and lines else b"") + "\n".join(lines).encode())
            return [out]

        return compute

    rows = segments.join(places, PLACE)
    return add_columns(rows, [F.col(c) for c in ("live", "roles", "texts", "edits", "given", "before")], "piece binary", make, ["key", *PLACE])


def repair_conversations(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """One row for each conversation of ``df`` as damaged by ``damaged``: faults, cheapest edits and the repaired text's digest.

    Turns are whole numbers. Conversations without rows after the damage have zeros, an empty audit and the digest of an
    empty text; an empty table gives no rows. Other columns are not read.
    """
    rows = damaged(df, conv_id, turn, role, text)
    hashes = [F.xxhash64("role", "text"), F.xxhash64(F.lit(13), "text", "role")]
    values = {
        "live": F.col("live"), "turns": F.col("turn"), "roles": F.col("role"), "texts": F.col("text"), "h1": hashes[0], "h2": hashes[1],
        "bytes": F.octet_length("text") + F.octet_length("role"),
    }
    segments = settle(packed(rows, F.col("conv_id"), [F.col("turn"), *hashes], values, "bytes", most_rows, most_bytes), "conversations")
    done = _whole(segments.filter("whole"))
    rest = segments.filter("not whole")
    firsts = _first_places(rest)
    letters = _letters(rest.join(firsts, PLACE, "left"))
    # null keys are one key in all that follows
    parsed = settle(_parsed(letters.withColumn("key", F.struct("key"))), "repairs")
    pieces = _rendered(rest.withColumn("key", F.struct("key")), parsed)
    digests = streamed_sha256(pieces.withColumn("name", F.col("key.key")).withColumn("none", F.isnull("name")), ["none", "name"], PLACE, "piece")
    digests = digests.withColumn("key", F.struct(F.col("name").alias("key"))).withColumnRenamed("sha256", "repaired_sha256")
    cut = parsed.join(digests, parsed["key"].eqNullSafe(digests["key"])).select(parsed["key.key"].alias("key"), *COUNTS, "audit", "repaired_sha256")
    return done.unionByName(cut).withColumnRenamed("key", "conv_id")
