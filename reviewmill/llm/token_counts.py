"""Token counts of whole texts, huge ones by overlapping chunks that are spliced again.

A text longer than `CHUNK` characters is encoded in chunks with offsets. Neighbouring
chunks share an overlap; they are spliced at a position where both encodings begin a
token, white space stands before it, and both give the same tokens from there for the
next `STABLE` tokens. White space ends every match of the pre-tokeniser, so from such a
position on the encodings can't differ. Where an overlap holds no such position, it is
widened until one is found or the rest of the text is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.common import slices, texts_of, utf8
from reviewmill.llm.word_tokens import WordTokens

CHUNK = 65_536
OVERLAP = 512
STABLE = 8
LIMIT = 2048


def _encoded(tokenizer, text: str, base: int) -> list[tuple[int, int]]:
    coded = tokenizer.encode(text, add_special_tokens=False)
    return [(base + low, token) for (low, _), token in zip(coded.offsets, coded.ids)]


def _splice(left: list, right: list, text: str, low: int, high: int) -> int | None:
    """A stable common boundary in [low, high), or None."""
    a = [t for t in left if low <= t[0] < high]
    b = [t for t in right if low <= t[0] < high]
    at = {}
    for j in range(len(b) - 1, -1, -1):
        at[b[j][0]] = j  # the first token that begins there
    for i, (start, _) in enumerate(a):
        j = at.get(start)
        if (
            j is not None and (i == 0 or a[i - 1][0] < start)
            and start > low and text[start - 1] in " \t\n\r\v\f"
            and len(a) - i >= STABLE and a[i:i + STABLE] == b[j:j + STABLE]
        ):
            return start
    return None


def spliced_ids(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a whole text from its overlapping chunks."""
    out: list[int] = []
    low, floor = 0, 0  # where the current chunk begins, and from where its tokens count
    size = chunk
    high = min(len(text), low + size)
    current = _encoded(tokenizer, text[low:high], low)
    while high < len(text):
        wide, cut = overlap, None
        while cut is None:
            begin = max(floor, high - wide)
            end = min(len(text), high + size)
            following = _encoded(tokenizer, text[begin:end], begin)
            cut = _splice(current, following, text, begin, high)
            if cut is None and begin == floor:  # no boundary in the whole chunk: enlarge it
                high = min(len(text), high + size)
                current = _encoded(tokenizer, text[low:high], low)
                if high == len(text):
                    break
                wide = overlap
            elif cut is None:
                wide *= 2
        if cut is None:
            break
        out += [t for start, t in current if floor <= start < cut]
        low, floor, current, high = begin, cut, following, end
    return out + [t for start, t in current if start >= floor]


def counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > `limit`) of every row's whole text.

    Null and empty texts count 0; every input row gives one row.
    """
    rows = texts_of(docs, "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.load(tokenizer)
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            made = np.zeros(batch.num_rows, np.int64)
            for low, high in slices(offsets, 1 << 20):
                sizes = np.diff(offsets[low:high + 1])
                long = sizes > chunk
                for i in low + np.flatnonzero(long):
                    text = data[offsets[i]:offsets[i + 1]].tobytes().decode()
                    made[i] = len(spliced_ids(words.tokenizer, text, chunk))
                short = low + np.flatnonzero(~long)
                texts = [data[offsets[i]:offsets[i + 1]].tobytes() for i in short]
                made[short] = [len(c) // 4 for c in words.encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(made)], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit)
