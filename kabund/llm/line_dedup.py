"""Line dedup: a segment-partition edit join over lines, with DataFrame functions only.

A line goes if an earlier line is within `edits` edits of it; what is earlier is told by (doc_id, text's hash, place in the text).
All lines but empty ones take part. A pair may differ by one edit for each 12 code points of its shorter line, up to `edits`, so that
lines under 12 go only if they are exact repeats.

Two lines within t edits share one of t + 1 segments of the shorter one exactly (Li et al., Pass-Join, 2011). A line puts
its segments into an index under their length, number and content; a line that looks for others takes from its own text just
the substrings that can be a segment of a line of a given length, which are few and at known offsets. Pairs that meet
are verified by a band of 2t + 1 diagonals, held as bits: for each number of errors a lane tells which diagonals can be
reached, and a character of the longer line moves all lanes at once.

Only hashes leave the texts' own partitions, but for the texts of pairs that meet and for one exchange of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kabund.llm.common import free_name, row_key, written

#: Characters whose counts tell most pairs of different lines apart before they are paired, and bits for each count.
COUNTED, BITS = "eniratsodhlu", 2
#: Bits of a segment's key. Keys ride in two dozen rows a line; what meets by chance is told apart when pairs are verified.
KEY_BITS = 40
#: Edits that make two lines the same, and code points of a line for each.
EDITS, EACH = 2, 12


def _let(value: Column, use) -> Column:
    """use(value), value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _trimmed(a: Column, b: Column) -> Column:
    """struct(a, b) without some of what both start or end with: halves that are equal, again and again, which changes no distance."""

    def step(s: Column, i: Column) -> Column:
        k = F.floor(F.length(s["a"]) / 2).cast("int")
        start = F.substring(s["a"], F.lit(1), k) == F.substring(s["b"], F.lit(1), k)
        front = F.struct(F.substring(s["a"], k + 1, F.length(s["a"])).alias("a"), F.substring(s["b"], k + 1, F.length(s["b"])).alias("b"))
        m, n = F.length(s["a"]) - k, F.length(s["b"]) - k
        end = F.substring(s["a"], m + 1, k) == F.substring(s["b"], n + 1, k)
        back = F.struct(F.substring(s["a"], F.lit(1), m).alias("a"), F.substring(s["b"], F.lit(1), n).alias("b"))
        return F.when(i % 2 == 0, F.when(start, front).otherwise(s)).otherwise(F.when(end, back).otherwise(s))

    return F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.struct(a.alias("a"), b.alias("b")), step)


def within_edits(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether b, at least as long as a, is within `edits` edits of a: true for equal strings, null where one is null.

    Lane e of the state has bit k set if the first i code points of a and the first j of b, i = j + k - edits, are within e
    edits. Lanes are of 8 bits, so that edits is 3 at most.
    """
    if not 0 <= edits <= 3:
        raise ValueError("edits must be from 0 to 3")
    width, lanes = 2 * edits + 1, edits + 1
    mask = sum(((1 << width) - 1) << (8 * e) for e in range(lanes))
    start = sum(1 << (8 * e + edits + d) for e in range(lanes) for d in range(e + 1))
    each = sum(1 << (8 * e) for e in range(lanes))
    points = lambda s: F.transform(F.split(s, ""), F.ascii)

    def closed(s: Column) -> Column:  # code points of a left out: one lane and one diagonal up, again and again
        out = s
        for d in range(1, edits + 1):
            out = out.bitwiseOR(F.shiftleft(s, 9 * d))
        return out.bitwiseAND(F.lit(mask).cast("long"))

    def step(ac: Column, bc: Column):
        def of(s: Column, j: Column) -> Column:
            same = F.lit(0).cast("long")
            at = F.get(bc, j)
            for k in range(width):
                same = same + F.when(F.get(ac, j + F.lit(k - edits)) == at, F.lit(each << k).cast("long")).otherwise(F.lit(0).cast("long"))
            moved = s.bitwiseOR(F.shiftright(s, 1).bitwiseAND(F.lit(mask >> 1 & mask).cast("long"))) if edits else F.lit(0).cast("long")
            return _let(s.bitwiseAND(same).bitwiseOR(F.shiftleft(moved, 8)).bitwiseAND(F.lit(mask).cast("long")), closed)

        return of

    def run(ab: Column) -> Column:
        ac, bc = ab["a"], ab["b"]
        n, m = F.size(bc), F.size(ac)
        end = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(start).cast("long"), step(ac, bc))
        return F.getbit(end, F.lit(8 * edits + edits) + m - n) == 1

    def rest(ab: Column) -> Column:  # what is left of a may be nothing
        return F.when(F.length(ab["a"]) > 0, _let(F.struct(points(ab["a"]).alias("a"), points(ab["b"]).alias("b")), run)).otherwise(F.lit(True))

    fits = (F.length(b) - F.length(a)).between(0, edits)
    return F.when(a == b, F.lit(True)).when(fits & (F.length(a) > 0), _let(_trimmed(a, b), rest)).otherwise(F.when(a.isNotNull() & b.isNotNull(), fits))


def _segment(n: Column, i: int, segments: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of a line of n code points; the last ones are longer by one."""
    size, longer = F.floor(n / F.lit(segments)).cast("int"), n % F.lit(segments)
    first_long = F.lit(segments) - longer  # segments up to this number are the short ones
    start = size * F.lit(i - 1) + F.greatest(F.lit(0), F.lit(i - 1) - first_long) + F.lit(1)
    return start, size + F.when(F.lit(i) > first_long, 1).otherwise(0)


def _key(n: Column, i: int, content: Column) -> Column:
    return F.xxhash64(n, F.lit(i), content).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def index_rows(lines: DataFrame, keep: list[str], budgets: list[tuple[int, int, int | None]]) -> DataFrame:
    """keep and _key: hashes of (length, number, content) of the segments of _wide, the line as four bytes a code point. A line's
    length tells which budget (edits, least, most), and so how many segments, it has."""
    n = _points(F.col("_wide"))
    keys = [F.when(_within(n, least, most), _key(n, i, _cut(*_segment(n, i, edits + 1)))) for edits, least, most in budgets for i in range(1, edits + 2)]
    return lines.select(*keep, F.explode_outer(F.array(*keys)).alias("_key")).where("_key is not null")


def _within(n: Column, least: int, most: int | None) -> Column:
    return n >= least if most is None else n.between(least, most)


def _points(wide: Column) -> Column:
    return F.shiftright(F.octet_length(wide), 2)


def _cut(at: Column, size: Column) -> Column:
    """Code points of _wide. In text, a place is found by walking there; in four bytes a code point it is known."""
    return F.substring("_wide", F.shiftleft(at, 2) - 3, F.shiftleft(size, 2))


def probe_rows(lines: DataFrame, keep: list[str], budgets: list[tuple[int, int, int | None]]) -> DataFrame:
    """keep, _same and _key: the keys under which lines of this length (_same) or of up to `edits` less would stand, if _wide is within
    the edits.

    A segment behind i - 1 others is off by i - 1 at most, and by what the lengths' difference leaves to those behind it
    (multi-match-aware selection).
    """
    keys: tuple[list[Column], list[Column]] = ([], [])  # for lines of one length, and for shorter ones
    whole = _points(F.col("_wide"))
    for edits, least, most in budgets:
        for d in range(edits + 1):
            n = whole - F.lit(d)
            for i in range(1, edits + 2):
                start, size = _segment(n, i, edits + 1)
                for off in range(max(-(i - 1), d - (edits + 1 - i)), min(i - 1, d + (edits + 1 - i)) + 1):
                    at = start + F.lit(off)
                    fits = _within(n, least, most) & (at >= 1) & (at + size - 1 <= whole)
                    keys[d > 0].append(F.when(fits, _key(n, i, _cut(at, size))))
    # as columns first: what they have in common is computed once, and the code is split into methods that get compiled
    each = lines.select(*keep, *[k.alias(f"_k{i}") for i, k in enumerate(keys[0] + keys[1])])
    out = each.select(*keep, F.posexplode_outer(F.array(*[f"_k{i}" for i in range(len(keys[0]) + len(keys[1]))])).alias("_i", "_key")).where("_key is not null")
    return out.select(*keep, (F.col("_i") < len(keys[0])).alias("_same"), "_key")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def counts_of(line: Column) -> Column:
    """Counts of the characters COUNTED, modulo 2^BITS each, in one int of 30 bits at most."""
    out = F.lit(0)
    for i, c in enumerate(COUNTED):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit((1 << BITS) - 1)), BITS * i))
    return out


def may_be_within(x: Column, y: Column, edits: int) -> Column:
    """True if lines with these counts can be within the edits: an edit changes two counts by one at most."""
    total, mask = F.lit(0), (1 << BITS) - 1
    for i in range(len(COUNTED)):
        d = (F.shiftright(x, BITS * i) - F.shiftright(y, BITS * i)).bitwiseAND(F.lit(mask))
        total = total + F.least(d, F.lit(mask + 1) - d)
    return total <= 2 * edits


#: What tells a row: its doc_id (the greatest long for none) and a hash of its doc_id and text, whose lowest bit says that there is no doc_id.
ROW = ["_doc", "_k"]
_NO_ID = (1 << 63) - 1


def _picked(base: DataFrame, lines: DataFrame) -> DataFrame:
    """(_place, _m, _line): of lines (_first: a struct of ROW and _at, _m, _c) the place, the number, the counts (_c) and the text."""
    first = F.col("_first")
    by_row = lines.select(first["_doc"].alias("_d"), first["_k"].alias("_dk"), F.struct(first["_at"].alias("at"), F.col("_m").alias("m"), F.col("_c").alias("c")).alias("_x"))
    by_row = by_row.groupBy("_d", "_dk").agg(F.collect_list("_x").alias("_xs")).hint("shuffle_hash")  # small next to the texts
    held = base.join(by_row, (F.col("_doc") == F.col("_d")) & (F.col("_k") == F.col("_dk")))
    picked = F.transform(F.array(_lines(F.col("_text"))), lambda ls: F.transform(F.col("_xs"), lambda x: F.struct(x["at"].alias("_at"), x["m"].alias("_m"), x["c"].alias("_c"), F.element_at(ls, x["at"] + 1).alias("_line"))))
    out = held.select(*ROW, F.explode_outer(F.element_at(picked, 1)).alias("_l")).where("_doc is not null and _l is not null")
    return out.select(F.struct(*ROW, F.col("_l._at").alias("_at")).alias("_place"), "_l._m", "_l._c", "_l._line")


def _budgets(edits: int) -> list[tuple[int, int, int | None]]:
    """(edits, least, most): what pairs may differ by, and the code points of their shorter lines."""
    return [(e, EACH * e, None if e == edits else EACH * (e + 1) - 1) for e in range(1, edits + 1)]


def _close(a: Column, b: Column, budgets: list[tuple[int, int, int | None]]) -> Column:
    """Whether b, at least as long as a, is within the edits that a's length allows."""
    out = within_edits(a, b, budgets[-1][0])
    for edits, _, most in reversed(budgets[:-1]):
        out = F.when(F.length(a) <= most, within_edits(a, b, edits)).otherwise(out)
    return out


def _near(base: DataFrame, firsts: DataFrame, budgets: list[tuple[int, int, int | None]]) -> DataFrame:
    """(d, k, a): the places of distinct lines within the edits of an earlier one that the shorter of both allows.

    What is paired are the numbers of lines, so that what rides along with a key does not grow with what tells a row.
    """
    part = firsts.where(F.col("_n_points") >= budgets[0][1]).select("_first", "_m", "_c")
    wide = _picked(base, part).select("_m", "_c", F.encode("_line", "UTF-32").alias("_wide"))
    entries, probes = index_rows(wide, ["_m", "_c"], budgets), probe_rows(wide, ["_m", "_c"], budgets)
    probes = probes.select(F.col("_m").alias("_pm"), F.when(F.col("_same"), F.col("_c").bitwiseOR(F.lit(1 << 30))).otherwise(F.col("_c")).alias("_pc"), "_key")
    # lines of one length look for each other both ways: one way is enough
    other = F.when(F.col("_pc") >= F.lit(1 << 30), F.col("_m") < F.col("_pm")).otherwise(F.col("_m") != F.col("_pm"))
    paired = entries.join(probes, "_key").where(other & may_be_within(F.col("_c"), F.col("_pc"), budgets[-1][0]))
    # said once more, so that the uses below stay one plan with those of the texts, whose exchange is then made once
    met = paired.select("_m", "_pm").where("_m is not null and _pm is not null").distinct()
    seen = met.select("_m").union(met.select("_pm")).distinct()
    texts = _picked(base, part.join(seen, "_m", "left_semi")).select(F.col("_m").alias("_tm"), "_place", "_line")
    one = met.join(texts, F.col("_m") == F.col("_tm")).select("_pm", F.col("_place").alias("_x"), F.col("_line").alias("_a"))
    both = one.join(texts, F.col("_pm") == F.col("_tm")).select("_x", "_a", F.col("_place").alias("_y"), F.col("_line").alias("_b"))
    later = F.greatest("_x", "_y")
    return both.where(_close(F.col("_a"), F.col("_b"), budgets)).select(later["_doc"].alias("d"), later["_k"].alias("k"), later["_at"].alias("a"))


def removed_lines(base: DataFrame, edits: int = EDITS) -> DataFrame:
    """(_gone_doc, _gone_k, _gone_ats): of each row, the places (from 0) of its lines that go. base: _doc, _k and _text, not null."""
    lines = base.select(*ROW, F.posexplode_outer(_lines(F.col("_text"))).alias("_at", "_line")).where(F.length("_line") > 0)
    hashed = lines.select(*ROW, "_at", F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(1), F.col("_line")).alias("_g"), counts_of(F.col("_line")).alias("_c"), F.length("_line").alias("_n_points"))
    # the first place of each distinct line, and a number, which it keeps as it is written
    firsts = hashed.groupBy("_h", "_g").agg(F.min(F.struct(*ROW, "_at")).alias("_first"), F.count("*").alias("_n"), F.min("_c").alias("_c"), F.min("_n_points").alias("_n_points"))
    firsts = written(firsts.withColumn("_m", F.monotonically_increasing_id()), "lines")
    # occurrences of a line behind its first one
    repeated = firsts.where("_n > 1").select("_h", "_g", "_first")
    gone = hashed.join(repeated, ["_h", "_g"]).where(F.struct(*ROW, "_at") != F.col("_first")).select(F.col("_doc").alias("d"), F.col("_k").alias("k"), F.col("_at").alias("a"))
    if budgets := _budgets(edits):  # a line that goes, goes everywhere: its other occurrences are later still
        gone = gone.union(_near(base, firsts, budgets))
    return gone.groupBy(F.col("d").alias("_gone_doc"), F.col("k").alias("_gone_k")).agg(F.collect_set("a").alias("_gone_ats"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the lines that repeat an earlier one taken out of text_col, and two more columns, _lines and _gone (with underscores
    behind them where docs has such columns): lines of a text, and how many went.

    All columns and rows of docs stay. A null text stays null; an empty text has one empty line, which stays. A line is earlier
    in a row with a lesser doc_id, of rows with one doc_id in that with the lesser hash of its text, and rows without a doc_id are the
    last. Rows that repeat both doc_id and text are one row, and all of them stay alike. Of pairs, one line goes if they are within
    the edits that their length allows, see above. length_col gets the new number of code points. An empty table gives an empty one.
    """
    has_text = F.col(text_col).isNotNull()
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    # _r: the other columns; without any, all exchanges of the texts are the same one
    others = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_r")] if rest else []
    ident, no_id = F.col(id_col).cast("long"), F.col(id_col).cast("long").isNull()
    key = row_key(ident, F.col(text_col).cast("string"))[0].bitwiseAND(F.lit(-2)).bitwiseOR(no_id.cast("long"))
    rows = docs.where(has_text).select(F.coalesce(ident, F.lit(_NO_ID)).alias("_doc"), key.alias("_k"), F.col(text_col).cast("string").alias("_text"), *others)
    gone = removed_lines(rows.select(*ROW, "_text"), edits).hint("shuffle_hash")
    lines = _lines(F.col("_text"))
    left = lambda ls: F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.col("_gone_ats"), s["i"]))
    text = F.when(F.col("_gone_ats").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left(lines), lambda s: s["x"]), "\n"))
    joined = rows.join(gone, (F.col("_doc") == F.col("_gone_doc")) & (F.col("_k") == F.col("_gone_k")), "left")
    kept = joined.select(*ROW, text.alias("_text"), *(["_r"] if rest else []), F.size(lines).alias("_total"), F.coalesce(F.size("_gone_ats"), F.lit(0)).alias("_went"))

    def column(c: str) -> Column:
        kind = docs.schema[c].dataType
        if c == id_col:
            return F.when(F.col("_k").bitwiseAND(F.lit(1)) == 0, F.col("_doc")).cast(kind).alias(c)
        if c == text_col:
            return F.col("_text").cast(kind).alias(c)
        return F.length("_text").cast(kind).alias(c) if c == length_col else F.col("_r")[c].alias(c)

    told = lambda *values: [x.alias(free_name(c, docs.columns)) for x, c in zip(values, ("_lines", "_gone"), strict=True)]
    kept = kept.select(*[column(c) for c in docs.columns], *told(F.col("_total"), F.col("_went")))
    return kept.unionByName(docs.where(~has_text).select("*", *told(F.lit(0), F.lit(0))))
