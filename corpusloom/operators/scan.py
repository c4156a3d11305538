"""Scans with state over documents that are larger than a task: a row for each line, blocks of lines by themselves.

A machine of few states reads a document's lines as symbols. What a block of lines does to each state that it may
be entered with is a function of states; the functions of a document's blocks, of which there are few, are
composed in order, which tells each block the state that it is entered with; and blocks are then filled in.
So a document of any number of lines is many tasks', and no task holds more than the lines of a block.

Places (`ord`) number a document's lines; those of equal place are in any order. Rows of a null document are
each for itself, as a document's first line is. Tables without rows give tables without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import constants as C
from corpusloom.functions import predicates as P
from corpusloom.functions.rules import RULES, Rules
from corpusloom.functions.text import lower, strip

#: Places of a block.
BLOCK_LINES = 200_000


def after(f: list[int], symbols: list[int], table: list[list[int]]) -> list[int]:
    """What is left of each state of f once the symbols have been read."""
    rest = iter(symbols)
    for s in rest:
        f = [table[x][s] for x in f]
        if all(x == f[0] for x in f):  # they have met: one state stands for all
            state = f[0]
            for s in rest:
                state = table[state][s]
            return [state] * len(f)
    return f


def _runs(*keys: list) -> Iterator[tuple[int, int, tuple]]:
    """(from, to, key) of the runs of equal keys."""
    rows = list(zip(*keys))
    cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
    return ((a, b, rows[a]) for a, b in zip(cuts, cuts[1:]) if b > a)


def states_before(df: DataFrame, symbol: Column, table: list[list[int]], start: int, id_col: str = "doc_id", ord_col: str = "ord", block_lines: int = BLOCK_LINES) -> DataFrame:
    """df with `_block`, a document's part that a line is in, and `_state`, the machine's before the line.

    `table` has the next state of each state and symbol; `start` is the state before a document's first line.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[id_col].dataType.simpleString()
    id_, place = F.col(id_col), F.col(ord_col)
    block = F.when(id_.isNull(), -1 - F.pmod(F.xxhash64(place), F.lit(4096))).otherwise(F.floor(place / block_lines)).cast("bigint")
    dealt = df.withColumn("_block", block).withColumn("_symbol", symbol.cast("int"))
    rows = dealt.where(id_.isNotNull()).select(id_col, "_block", ord_col, "_symbol")

    def functions(batches) -> Iterator[pa.RecordBatch]:
        now, f = None, list(range(len(table)))
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            ids, blocks, exits = zip(*((*key, f) for key, f in done)) if done else ((), (), ())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(blocks, pa.int64()), pa.array(exits, pa.list_(pa.int32()))], names=[id_col, "_block", "_exits"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            symbols = batch.column(3).to_pylist()
            for a, b, key in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, f))
                    now, f = key, list(range(len(table)))
                f = after(f, symbols[a:b], table)
            if len(done) > 1000:
                yield out()
        if now is not None:
            done.append((now, f))
            yield out()

    def compose(batches) -> Iterator[pa.RecordBatch]:
        now, state = None, start
        for batch in batches:
            entered = []
            for id_value, exits in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if id_value != now:
                    now, state = id_value, start
                entered.append(state)
                state = exits[state]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entered, pa.int32())], names=[id_col, "_block", "_enter"])

    exits = rows.repartition(n, id_col, "_block").sortWithinPartitions(id_col, "_block", ord_col, "_symbol").mapInArrow(functions, f"`{id_col}` {kind}, _block bigint, _exits array<int>")
    entered = exits.repartition(n, id_col).sortWithinPartitions(id_col, "_block").mapInArrow(compose, f"`{id_col}` {kind}, _block bigint, _enter int")

    def fill(batches) -> Iterator[pa.RecordBatch]:
        now, state = None, start
        for batch in batches:
            at = {name: batch.schema.get_field_index(name) for name in (id_col, "_block", "_symbol", "_enter")}
            ids, blocks, symbols, enters = (batch.column(i).to_pylist() for i in at.values())
            states: list[int | None] = []
            for key, s, enter in zip(zip(ids, blocks), symbols, enters):
                if key != now or key[0] is None:
                    now, state = key, start
                if enter is not None:  # a block's first row, which says how it is entered
                    state = enter
                    states.append(None)
                else:
                    states.append(state)
                    state = table[state][s]
            keep = [i for i in range(batch.num_columns) if i not in (at["_symbol"], at["_enter"])]
            found = pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(states, pa.int32())], names=[*(batch.schema.names[i] for i in keep), "_state"])
            yield found.filter(found.column(len(keep)).is_valid())

    # the way in comes as a row before a block's lines, so that these are shuffled once
    both = dealt.withColumn("_enter", F.lit(None).cast("int")).unionByName(entered, allowMissingColumns=True)
    both = both.repartition(n, id_col, "_block").sortWithinPartitions(id_col, "_block", F.col("_enter").isNull(), ord_col, "_symbol")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "_symbol"]
    return both.mapInArrow(fill, ", ".join([*fields, "_state int"]))


#: Outside a correspondence block, or inside; symbols have 1 for a line that opens one and 2 for one that ends it.
NOISE_MACHINE = [[0, 1, 0, 1], [1, 1, 0, 0]]


def classify_noise(df: DataFrame, id_col: str = "doc_id", line_col: str = "line", block_lines: int = BLOCK_LINES, rules: Rules = RULES) -> DataFrame:
    """As lines.classify_noise(), df and `category`, for documents of any number of lines."""
    line, blank = F.col(line_col), F.col(line_col) == ""
    df = df.withColumn("_low", lower(line)).withColumns({"_form": P.heading_form(line), "_terms": P.affiliation_terms(F.col("_low"), rules)})
    own = P.Line(line, F.col("_low"), F.col("_form"), F.col("_terms"))
    known = F.coalesce(~blank, F.lit(False)) & F.col(id_col).isNotNull()
    df = df.withColumns({"_t": known & P.ends_block(own, rules), "_s": known & P.starts_correspondence(own), "_c": F.when(known, P.noise_category(own, rules))}).drop("_low", "_form", "_terms")
    found = states_before(df, F.col("_s").cast("int") + 2 * F.col("_t").cast("int"), NOISE_MACHINE, 0, id_col, block_lines=block_lines)
    inside = F.when(~F.col("_t"), "correspondence")
    category = F.when(~known, None).when(F.col("_state") == 1, inside).when(F.col("_s"), "correspondence").otherwise(F.col("_c"))
    return found.withColumn("category", category).drop("_t", "_s", "_c", "_state", "_block")


class Joiner:
    """The machine of joined lines: what the line that has been joined so far is, as far as the next one has to know.

    It may be no heading any more (`OTHER`), or the next line begins anew whatever it is (`APART`), or it is a
    bare number, or the first words of a section's name, which the next line may make a heading.
    """

    OTHER, APART, NUMBER = range(3)
    HARD = 0  # the symbol of a line that is empty or a heading by itself

    def __init__(self):
        names = [n.split(" ") for n in C.SECTION_NAMES]
        self.names = set(C.SECTION_NAMES)
        self.begun = sorted({" ".join(n[:k]) for n in names for k in range(1, len(n))} - self.names)
        self.pieces = sorted({" ".join(n[a:b]) for n in names if len(n) > 1 for a in range(len(n)) for b in range(a + 1, len(n) + 1)})
        self.table = [[self._next(state, s) for s in range(1 + 32 * (len(self.pieces) + 1))] for state in range(3 + len(self.begun))]

    def _begun(self, text: str, other: int) -> int:
        return 3 + self.begun.index(text) if text in self.begun else other

    def _next(self, state: int, symbol: int) -> int:
        if symbol == self.HARD:
            return self.APART
        bits, piece = (symbol - 1) % 32, (symbol - 1) // 32
        lead, trail, closed, short, number = (bits >> i & 1 for i in range(5))
        words = self.pieces[piece - 1] if piece else None
        end = self.APART if closed else self.OTHER
        if state == self.OTHER or closed:
            return end
        if state == self.APART:
            return self.NUMBER if number else self._begun(words, end) if words and not trail else end
        if state == self.NUMBER:
            return self.APART if short else end
        joined = f"{self.begun[state - 3]} {words}"
        if words is None or lead:
            return end
        return self.APART if joined in self.names else end if trail else self._begun(joined, end)

    def symbol(self, x: Column) -> Column:
        """A line's symbol: is it empty or a heading; else its words, if they are some of a name's, and what stands around them."""
        form, clean = P.heading_form(x), strip(x)
        hard = (x == "") | P.is_section_heading(x)
        known = F.create_map(*[y for i, w in enumerate(self.pieces, 1) for y in (F.lit(w), F.lit(i))])
        piece = F.coalesce(F.try_element_at(known, form), F.lit(0))
        low = lower(x)
        bit = lambda flag, i: F.coalesce(flag, F.lit(False)).cast("int") * (1 << i)
        bits = bit(~low.startswith(form), 0) + bit(~low.endswith(form), 1) + bit(F.right(x, F.lit(1)).rlike(r"[.:;?!)\]}]"), 2) + bit(F.length(clean) <= 120, 3)
        bits += bit(x.rlike(r"(?U)\A\s*\d+(?:\.\d+)*\s*\z"), 4)
        return F.when(F.coalesce(hard, F.lit(False)), self.HARD).otherwise(1 + 32 * piece + bits)


JOINER = Joiner()


def join_wrapped(df: DataFrame, id_col: str = "doc_id", line_col: str = "line", block_lines: int = BLOCK_LINES) -> DataFrame:
    """id, ord, line: lines that go on in the next joined with it, as lines.join_wrapped() does; `ord` is that of the first.

    A null line is an empty one. Rows of a null document are left as they are. Other columns are not read.
    """
    rows = df.select(id_col, "ord", F.coalesce(F.col(line_col), F.lit("")).alias("line"))
    rows = rows.withColumn("_s", JOINER.symbol(F.col("line")))
    found = states_before(rows, F.col("_s"), JOINER.table, JOINER.APART, id_col, block_lines=block_lines)
    found = found.withColumn("_apart", (F.col("_state") == JOINER.APART) | (F.col("_s") == JOINER.HARD))
    none = found.where(F.col(id_col).isNull()).select(id_col, "ord", "line")
    found = found.where(F.col(id_col).isNotNull())
    # where a line's joined one begins: in its block, or else in one before, of which there are few
    begins = F.when(F.col("_apart"), F.col("ord"))
    last = found.groupBy(id_col, "_block").agg(F.max(begins).alias("_last"))
    before = Window.partitionBy(id_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(id_col, "_block", F.max("_last").over(before).alias("_before"))
    inside = Window.partitionBy(id_col, "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("_own", F.max(begins).over(inside)).join(last, [id_col, "_block"]).withColumn("_first", F.coalesce("_own", "_before"))
    joined = placed.groupBy(id_col, "_first").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("_x"))
    return joined.select(id_col, F.col("_first").alias("ord"), F.array_join(F.transform("_x", lambda z: z["line"]), " ").alias("line")).unionByName(none)


def _with_first(df: DataFrame, id_col: str, **marks: Column) -> DataFrame:
    """df with the first place of each mark in its document, null if there is none: counted before anything is shuffled."""
    firsts = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.min(F.when(m, F.col("ord"))).alias(name) for name, m in marks.items()])
    return df.join(firsts, id_col, "left")


def trim_front_matter(df: DataFrame, id_col: str = "doc_id", line_col: str = "line") -> DataFrame:
    """As lines.trim_front_matter(), for documents of any number of lines."""
    line = F.col(line_col)
    found = _with_first(df, id_col, _one=P.is_first_anchor(line), _two=P.is_second_anchor(line))
    found = found.withColumn("start", F.coalesce("_one", "_two", F.lit(0)))
    return found.where(F.col(id_col).isNull() | (F.col("ord") >= F.col("start"))).select(*df.columns, "start")


def trim_references(df: DataFrame, id_col: str = "doc_id", line_col: str = "line") -> DataFrame:
    """As lines.trim_references(), for documents of any number of lines."""
    found = _with_first(df, id_col, _end=P.is_references_heading(F.col(line_col)))
    return found.where("_end is null or ord < _end").select(*df.columns)
