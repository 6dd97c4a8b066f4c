"""Fill-in-the-middle transformation: texts cut at two random ranks of their tokens.

The tokens of a text are the nodes of an indexable skip list.  Lane 0 has all of them, each lane
above a random quarter of the one below; every link knows how many tokens and how many code
points it passes.  A cut rank is reached by following links, from the topmost lane down, as long
as the tokens passed do not exceed it; the code points passed on the way are the place of the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from statuspulse.llm.kernel import mix

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of transformed texts handed back to Spark at a time.
BATCH_BYTES = 4 << 20


def widths(text: str) -> np.ndarray:
    """Code points of each token: white space and the word after it, or white space at the end."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = (points == 0x20) | (points - np.uint32(9) < 5)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.diff(ends, prepend=0, append=len(points))


class SkipList:
    """Ranks of tokens to code points.

    A lane is three arrays over its nodes, the head first: the node's index in the lane below, and
    the tokens and code points that the link to the next node passes.  The last node's link leads
    one token further than any rank and is never followed.
    """

    def __init__(self, code_points: np.ndarray):
        size = len(code_points)
        down = np.arange(size + 1)
        rank = down
        units = np.ones(size + 1, np.int64)
        points = np.append(code_points, 0)
        draws = mix(np.arange(size + 1, dtype=np.uint64))
        self.lanes = [(down, units, points)]
        while len(rank) > 4:
            rises = draws[rank] & np.uint64(3) == 0
            draws = draws >> np.uint64(2)
            rises[0] = True
            down = np.flatnonzero(rises)
            if len(down) == len(rank):
                break
            rank = rank[down]
            units = np.add.reduceat(units, down)
            points = np.add.reduceat(points, down)
            self.lanes.append((down, units, points))

    def code_points(self, rank: int) -> int:
        """Code points of the first ``rank`` tokens."""
        at = passed = reached = 0
        for down, units, points in reversed(self.lanes):
            while passed + units[at] <= rank:
                passed += units[at]
                reached += points[at]
                at += 1
            at = down[at]
        return int(reached)


def draws(id_: Column, seed: str = "42:") -> list[Column]:
    """Four unsigned integers: the first four groups of eight hex digits of a SHA-256.  A null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rate: int = 50,
    spm_rate: int = 80,
    seed: str = "42:",
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output; a row per row of ``docs``.

    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of these in the form spm (suffix,
    prefix, middle) and the others in psm (prefix, suffix, middle).  A null or empty text, and one
    that holds a mark, is left plain: its output is the text (empty for null).  The draws depend on
    the id alone, so repeated rows are cut alike; a null id draws as an empty one.  Texts of any
    length are cut whole; other columns are ignored.
    """
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(docs[id_column], seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (F.pmod(h3, F.lit(100)) >= rate)
    spm = F.pmod(h4, F.lit(100)) < spm_rate
    rows = docs.select(
        docs[id_column].alias("doc_id"),
        text.alias("text"),
        h1.alias("h1"),
        h2.alias("h2"),
        F.when(plain, "plain").when(spm, "spm").otherwise("psm").alias("form"),
    )
    kind = docs.schema[id_column].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            held = 0
            for k in range(batch.num_rows):
                id_, text, h1, h2, form = (batch.column(c)[k].as_py() for c in range(5))
                units = widths(text)
                n, prefix, middle, output = len(units), None, None, text
                if form != "plain":
                    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                    ranks = SkipList(units)
                    prefix, end = ranks.code_points(first), ranks.code_points(second)
                    middle = end - prefix
                    parts = text[:prefix], text[prefix:end], text[end:]
                    output = join(*parts, form)
                for column, value in zip(columns, (id_, n, form, prefix, middle, output)):
                    column.append(value)
                held += len(output)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=schema)
                    columns, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=schema)

    return rows.mapInArrow(
        run,
        f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def join(prefix: str, middle: str, suffix: str, form: str) -> str:
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: Column, form: Column) -> Column:
    """The text from a transformed one.  A text holds no mark, so its three parts are what stands between marks."""
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, middle = (F.get(parts, F.lit(k)) for k in range(3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(
        form == "spm", F.concat(second, middle, first)
    ).otherwise(output)
