"""Operators on a document's lines in order.

In long form, a row for each line with its place `ord`, windows by document do what a scan with state
does. In array form the same is done within the row, in time that grows with the number of lines; the
pipeline uses that, without a shuffle.

A null line is neither noise nor heading; an empty one is blank. Documents without a line stay without
one. In long form rows of a null document are kept as they are, without category or start, and are no one
task's. Lines of equal place are in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import constants as C
from corpusloom.functions import predicates as P
from corpusloom.functions.rules import RULES, Rules
from corpusloom.functions.text import let, lower

COUNTS = ("front_matter", "publisher_metadata", "correspondence", "author_blocks", "graphics", "references", "other_noise")


def _documents(id_col: str) -> tuple[Column, ...]:
    """Columns that a window goes by: the document, and for rows of none a share of them each."""
    return F.col(id_col), F.when(F.col(id_col).isNull(), F.xxhash64("ord") % 4096)


def trim_front_matter(df: DataFrame, id_col: str = "doc_id", line_col: str = "line") -> DataFrame:
    """Lines from the first abstract or summary on, else from the first introduction or background, else all; with `start`."""
    w, form = Window.partitionBy(*_documents(id_col)), F.col("_form")
    df = df.withColumn("_form", P.heading_form(F.col(line_col)))
    first, second = (F.min(F.when(form.isin(*names) & F.col(id_col).isNotNull(), F.col("ord"))).over(w) for names in (C.FIRST_ANCHORS, C.SECOND_ANCHORS))
    return df.withColumn("start", F.coalesce(first, second, F.lit(0))).where(F.col(id_col).isNull() | (F.col("ord") >= F.col("start"))).drop("_form")


def trim_references(df: DataFrame, id_col: str = "doc_id", line_col: str = "line") -> DataFrame:
    """Lines before the first heading of a reference list."""
    w = Window.partitionBy(*_documents(id_col))
    end = F.min(F.when(P.is_references_heading(F.col(line_col)) & F.col(id_col).isNotNull(), F.col("ord"))).over(w)
    return df.withColumn("_end", end).where("_end is null or ord < _end").drop("_end")


def classify_noise(df: DataFrame, id_col: str = "doc_id", line_col: str = "line", rules: Rules = RULES) -> DataFrame:
    """df and `category`: what each line is dropped as, null if it is kept.

    A correspondence opener begins a block, which a heading or a long line without contact data ends.
    Whether a line lies in a block is the state before it: the last line that sets the state decides,
    changed by each line after it that is an opener and an end at once.
    """
    line, blank = F.col(line_col), F.col(line_col) == ""
    order = Window.partitionBy(*_documents(id_col)).orderBy("ord")
    # what several rules need is a column of its own, which the optimizer doesn't compute again for each
    df = df.withColumn("_low", lower(line)).withColumns({"_form": P.heading_form(line), "_terms": P.affiliation_terms(F.col("_low"), rules)})
    own = P.Line(line, F.col("_low"), F.col("_form"), F.col("_terms"))
    known = ~blank & F.col(id_col).isNotNull()
    df = df.withColumns({"_t": known & P.ends_block(own, rules), "_s": known & P.starts_correspondence(own), "_c": F.when(known, P.noise_category(own, rules))}).drop("_low", "_form", "_terms")
    df = df.withColumn("_k", F.when(F.col("_s") & ~F.col("_t"), 1).when(F.col("_t") & ~F.col("_s"), 0))
    df = df.withColumn("_seg", F.count("_k").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    segment = Window.partitionBy(*_documents(id_col), "_seg")
    flips = F.sum(F.when(F.col("_s") & F.col("_t"), 1).otherwise(0)).over(segment.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_after", (F.coalesce(F.max("_k").over(segment), F.lit(0)) + flips) % 2)
    inside = F.coalesce(F.lag("_after").over(order), F.lit(0)) == 1
    category = F.when(blank, None).when(inside, F.when(~F.col("_t"), "correspondence")).when(F.col("_s"), "correspondence").otherwise(F.col("_c"))
    return df.withColumn("category", category).drop("_t", "_s", "_c", "_k", "_seg", "_after")


def cleanup_counts(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines dropped of each category, by document."""
    kinds = [c for c in COUNTS if c not in ("front_matter", "references")]
    return df.groupBy(id_col).agg(*[F.count(F.when(F.col("category") == c, 1)).alias(c) for c in kinds])


def front_start(lines: Column) -> Column:
    """The place of the first line to keep, on an array."""

    def go(forms: Column) -> Column:
        first, second = (F.array_position(F.transform(forms, lambda f: f.isin(*names)), True) for names in (C.FIRST_ANCHORS, C.SECOND_ANCHORS))
        return F.when(first > 0, first - 1).when(second > 0, second - 1).otherwise(0).cast("int")

    return let(F.transform(lines, P.heading_form), go)


def references_start(lines: Column) -> Column:
    """The place of the reference list's heading, the array's size if there is none."""
    at = F.array_position(F.transform(lines, P.is_references_heading), True)
    return F.when(at > 0, at - 1).otherwise(F.size(lines)).cast("int")


def noise_categories(lines: Column, rules: Rules = RULES) -> Column:
    """The category of each line of an array, `` for kept ones.

    Each line is a sign in a text: `b` blank, `t` ends a block, `s` opens one, `x` is both, `-` neither. A
    block goes from an opener, `s` or `x`, to before the next `t` or `x`; so one regular expression over
    the signs finds all blocks.
    """

    def judged(x: Column) -> Column:
        own = P.of(x)
        ends, opens = P.ends_block(own, rules), P.starts_correspondence(own)
        sign = F.when(own.x == "", "b").when(ends & opens, "x").when(ends, "t").when(opens, "s").otherwise("-")
        return F.struct(sign.alias("sign"), F.when(own.x == "", "").otherwise(F.coalesce(P.noise_category(own, rules), F.lit(""))).alias("c"))

    def marked(all_: Column) -> Column:
        signs = F.array_join(F.transform(all_, lambda z: z["sign"]), "")
        # `<` block `>` the line that ends it, if any `;`
        parts = F.split(F.regexp_replace(signs, "([sx][b\\-s]*+)([tx]?)", "<$1>$2;"), "<", -1)
        flags = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(_in_block(p))), "")
        return F.zip_with(all_, F.split(flags, ""), lambda z, f: F.when(f == "c", "correspondence").when((f == "k") | (f == "b"), "").otherwise(z["c"]))

    found = let(F.transform(F.transform(lines, lambda x: P.facts(x, rules)), judged), marked)
    return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(found)


def _in_block(part: Column) -> Column:
    """Signs before `>` become `c`, except blank ones; the one between that and `;`, if any, `k`; what follows stays."""
    inside, rest = F.substring_index(part, ">", 1), F.substring_index(part, ">", -1)
    after = lambda n: F.substring(rest, F.lit(n), F.length(rest))
    return F.concat(F.translate(inside, "sx-", "ccc"), F.when(rest.startswith(";"), after(2)).otherwise(F.concat(F.lit("k"), after(3))))


#: Stands between lines that may go on in the next: lines have no such character.
SOFT = "\x01"
#: From where a joined line begins: joined lines that are a heading, up to where they became one.
_BLANK, _ANY = r"[\s&&[^\n]]", rf"[\s{SOFT}&&[^\n]]"
_NAMES = "|".join(n.replace(" ", f"[ {SOFT}]") for n in sorted(C.SECTION_NAMES, key=len, reverse=True))
_JOINED_NAME = rf"{_ANY}*[ .:\-{SOFT}]*(?i:{_NAMES})[ .:\-]*{_BLANK}*"
_JOINED_NUMBER = rf"{_ANY}*\d+(?:\.\d+)*\.?{_ANY}+[^\s{SOFT}][^\n{SOFT}]{{0,119}}{_BLANK}*"
JOINED_HEADING = rf"(?U)(?:\A|(?<=\n)|\G)({_JOINED_NAME}|{_JOINED_NUMBER}){SOFT}"


def join_wrapped(lines: Column) -> Column:
    """Lines that go on in the next joined with it. Empty lines, headings and closing punctuation stand between.

    Lines are of one row and without control characters. What one line and the one before it tell is found
    line by line; that lines became a heading only by being joined, by one regular expression.
    """
    facts = F.transform(lines, lambda x: F.struct(x.alias("x"), (x == "").alias("blank"), P.is_section_heading(x).alias("heading"), F.right(x, F.lit(1)).rlike(r"[.:;?!)\]}]").alias("closed")))

    def joined(all_: Column) -> Column:
        def piece(z: Column, i: Column) -> Column:
            last = F.element_at(all_, F.greatest(i, F.lit(1)))
            apart = z["blank"] | z["heading"] | last["blank"] | last["heading"] | last["closed"]
            return F.concat(F.when(i == 0, "").when(apart, "\n").otherwise(SOFT), z["x"])

        text = F.array_join(F.transform(all_, piece), "")
        apart = F.when(text.contains(SOFT), F.regexp_replace(text, JOINED_HEADING, "$1\n")).otherwise(text)
        return F.split(F.translate(apart, SOFT, " "), "\n", -1)

    return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(let(facts, joined))
