"""Unicode NFKC as a deterministic column expression.

Tables of decompositions, combining classes and composites are read once per session from the Unicode library that Spark
ships, one job over the code points. Texts of characters that stay as they are, which is nearly every text, pass after one
pattern. Others are cut into pieces before each character that begins anew; a piece of one character is looked up, a longer one
is decomposed, put in canonical order and composed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOP = 0x30000  # no code point from here on is decomposed or combines; tests compare all of them
LAST = 0x10FFFF
BLOCK_BITS = 5
BLOCK = 1 << BLOCK_BITS
# The syllables that are composed by rule.
SYLLABLE, LEAD, VOWEL, TAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
LEADS, VOWELS, TAILS = 19, 21, 28
SYLLABLES = LEADS * VOWELS * TAILS
LONG_RUN = 64  # code points that stay as they are, in the pattern
ENTRY = "struct<s:string,d:array<int>,c:int,p:map<string,int>>"


@dataclass(frozen=True)
class Tables:
    """``index``: the block of each 32 code points; ``blocks``: of each code point its NFKC s, its compatibility decomposition d,
    its combining class c, and p, what it makes with a character before it; ``joins``: pattern of characters that do not
    begin anew; ``moving``: pattern of a character outside the long runs of those that always stay."""

    index: str
    blocks: str
    joins: str
    moving: str


_TABLES: dict[str, Tables] = {}


def tables(spark: SparkSession) -> Tables:
    place = spark.sparkContext.applicationId
    if place not in _TABLES:
        _TABLES[place] = _built(spark)
    return _TABLES[place]


def _built(spark: SparkSession) -> Tables:
    call = "java_method('com.ibm.icu.text.Normalizer', '{}', c, {})"
    points = spark.range(TOP).filter("id < 55296 or id > 57343").selectExpr("id", "java_method('java.lang.Character', 'toString', cast(id as int)) AS c")
    found = points.selectExpr(
        "id", "c", f"{call.format('compose', 'true')} AS nfkc", f"{call.format('decompose', 'true')} AS nfkd", f"{call.format('compose', 'false')} AS nfc",
        f"{call.format('decompose', 'false')} AS nfd", "cast(java_method('com.ibm.icu.lang.UCharacter', 'getCombiningClass', cast(id as int)) as int) AS ccc",
    ).filter(f"(nfkd <> c or ccc > 0) and (id < {SYLLABLE} or id >= {SYLLABLE + SYLLABLES})").collect()  # some thousand rows
    rows = {r["id"]: r for r in found}
    whole = {r["nfd"]: r["id"] for r in found if r["nfc"] == r["c"] and len(r["nfd"]) > 1}
    made: dict[int, dict[str, int]] = {}
    for nfd, composite in whole.items():
        first = whole.get(nfd[:-1]) if len(nfd) > 2 else ord(nfd[0])
        if first is not None:
            made.setdefault(ord(nfd[-1]), {})[str(first)] = composite
    joins = {i for i, r in rows.items() if r["ccc"]} | set(made) | set(range(VOWEL, VOWEL + VOWELS)) | set(range(TAIL + 1, TAIL + TAILS))
    joins |= {i for i, r in rows.items() if ord(r["nfkd"][0]) in joins}
    changing = sorted(joins | {i for i, r in rows.items() if r["nfkc"] != r["c"]})
    index, blocks = [-1] * (TOP // BLOCK), []
    for i in sorted(set(rows) | set(made)):
        if index[i // BLOCK] < 0:
            index[i // BLOCK] = len(blocks)
            blocks.append([None] * BLOCK)
        r = rows.get(i)
        entry = {"c": r["ccc"]} if r and r["ccc"] else {}
        if r and r["nfkc"] != r["c"]:
            entry["s"] = r["nfkc"]
        if r and r["nfkd"] != r["c"]:
            entry["d"] = [ord(x) for x in r["nfkd"]]
        if i in made:
            entry["p"] = made[i]
        blocks[index[i // BLOCK]][i % BLOCK] = entry
    edges = [-1, *changing, LAST + 1]
    steady = [(a + 1, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > (LONG_RUN if a > 0x250 else 8)]
    del index[max(i for i, b in enumerate(index) if b >= 0) + 1 :]
    short = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    # a class of many runs is slow, so it is asked only of what is neither ASCII nor a usual letter
    moving = f"[[^\\x00-\\x7F]&&[^{_class([r for r in steady if r[0] < 0x250])}]&&[^{_class(steady)}]]"
    return Tables(short(index), short(blocks), _class(_runs(sorted(joins))), moving)


def _runs(points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def _class(runs: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


def _bind(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def nfkc(text: Column) -> Column:
    """The NFKC of a text; null stays null."""
    t = tables(SparkSession.active())
    # literals once the plan is optimised
    known = F.struct(F.from_json(F.lit(t.index), "array<int>").alias("index"), F.from_json(F.lit(t.blocks), f"array<array<{ENTRY}>>").alias("blocks"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)[^{t.joins}][{t.joins}]*|[{t.joins}]+"), F.lit(0))
    normal = _bind(known, lambda k: F.array_join(F.transform(pieces, lambda p: _piece(p, k)), ""))
    return F.when(text.rlike(t.moving), normal).otherwise(text)


def _entry(point: Column, known: Column) -> Column:
    block = F.get(known["index"], F.shiftright(point, BLOCK_BITS))
    return F.get(F.get(known["blocks"], block), point.bitwiseAND(BLOCK - 1))


def _piece(piece: Column, known: Column) -> Column:
    alone = F.coalesce(_entry(F.ascii(piece), known)["s"], piece)
    return F.when(F.length(piece) == 1, alone).otherwise(_composed(piece, known))


def _composed(piece: Column, known: Column) -> Column:
    letters = F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0))
    points = F.flatten(F.transform(letters, lambda c: _bind(F.ascii(c), lambda p: _decomposed(p, known))))
    classed = F.transform(points, lambda p: F.struct(p.alias("p"), F.coalesce(_entry(p, known)["c"], F.lit(0)).alias("c")))

    def ordered(marks: Column) -> Column:
        starters = lambda i: F.size(F.filter(F.slice(marks, F.lit(1), i + 1), lambda m: m["c"] == 0))
        return F.array_sort(F.transform(marks, lambda m, i: F.struct(starters(i).alias("s"), m["c"].alias("c"), i.alias("i"), m["p"].alias("p"))))

    none = F.array().cast("array<int>")
    start = F.struct(none.alias("out"), F.lit(-1).alias("at"), F.lit(-1).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        made = F.when((acc["at"] >= 0) & (acc["last"] < x["c"]), _composite(F.get(acc["out"], acc["at"]), x["p"], known))

        def with_made(m: Column) -> Column:
            replaced = F.transform(acc["out"], lambda v, i: F.when(i == acc["at"], m).otherwise(v))
            begins = x["c"] == 0
            return F.when(m.isNotNull(), F.struct(replaced.alias("out"), acc["at"].alias("at"), acc["last"].alias("last"))).otherwise(F.struct(
                F.concat(acc["out"], F.array(x["p"])).alias("out"), F.when(begins, F.size(acc["out"])).otherwise(acc["at"]).alias("at"),
                F.when(begins, -1).otherwise(x["c"]).alias("last"),
            ))

        return _bind(made, with_made)

    out = F.aggregate(_bind(classed, ordered), start, step)["out"]
    return F.decode(F.unhex(F.array_join(F.transform(out, lambda p: F.lpad(F.hex(p), 8, "0")), "")), "UTF-32")


def _decomposed(point: Column, known: Column) -> Column:
    s = point - SYLLABLE
    lead, vowel, tail = (
        (F.lit(LEAD) + F.floor(s / (VOWELS * TAILS))).cast("int"), (F.lit(VOWEL) + F.floor(s % (VOWELS * TAILS) / TAILS)).cast("int"),
        (F.lit(TAIL) + s % TAILS).cast("int"),
    )
    syllable = F.when(s % TAILS == 0, F.array(lead, vowel)).otherwise(F.array(lead, vowel, tail))
    return F.when((s >= 0) & (s < SYLLABLES), syllable).otherwise(F.coalesce(_entry(point, known)["d"], F.array(point)))


def _composite(a: Column, b: Column, known: Column) -> Column:
    """What two code points make together, or null."""
    s = a - SYLLABLE
    lead_vowel = a.between(LEAD, LEAD + LEADS - 1) & b.between(VOWEL, VOWEL + VOWELS - 1)
    with_tail = (s >= 0) & (s < SYLLABLES) & (s % TAILS == 0) & b.between(TAIL + 1, TAIL + TAILS - 1)
    pair = F.try_element_at(_entry(b, known)["p"], a.cast("string"))
    return (
        F.when(lead_vowel, (F.lit(SYLLABLE) + ((a - LEAD) * VOWELS + (b - VOWEL)) * TAILS).cast("int"))
        .when(with_tail, (a + b - TAIL).cast("int")).otherwise(pair)
    )
