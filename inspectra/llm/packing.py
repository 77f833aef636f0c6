"""Filling containers of fixed capacity with texts measured in tokens, by sum-of-squares packing.

Each item goes where the sum over all residual gaps of the squared number of open containers with that gap becomes
smallest; that keeps gaps of all sizes at hand and leaves little room unused. Texts are measured where they are
read; what is moved is one number an item.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where the vocabulary files lie unless told otherwise; the pattern by which a text is cut before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items that one task packs; the gaps still open at its end are spread over so many items.
GROUP_ITEMS = 50_000
#: Characters that are tokenized at a time; longer texts are cut after a line or a blank.
PIECE_CHARS = 200_000

_encoders: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The byte-pair encoder of a vocabulary of ``base64 rank`` lines, made once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def text_pieces(text: str) -> list[str]:
    """The text cut before a blank that follows no blank, every ``PIECE_CHARS`` characters or later; joined they are the text.

    No token crosses such a cut, so counts add up and a very long run of text needs little memory.
    """
    out, at = [], 0
    while len(text) - at > PIECE_CHARS:
        cut = at + PIECE_CHARS
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum() and cut + 1 < len(text) and text[cut + 1].isalnum()):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text; NULL and empty texts have none."""
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([sum(len(enc.encode_ordinary(p)) for p in text_pieces(t)) if isinstance(t, str) and t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def sum_of_squares(sizes: Iterator[int] | np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(container of each item, room used in each container)``; sizes are between 1 and ``capacity``."""
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = np.zeros(0, np.int64)
    where, used = [], []
    for s in sizes:
        s = int(s)
        best_gap, best = -1, 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        gaps = open_gaps[np.searchsorted(open_gaps, s):]
        if len(gaps):
            after = count[gaps - s]
            cost = 2 * (after - count[gaps]) + 2
            if gaps[0] == s:
                cost[0] = 1 - 2 * count[s]  # the container is full and leaves the count
            k = int(np.argmin(cost))
            if cost[k] <= best:
                best_gap = int(gaps[k])
        if best_gap < 0:
            bin_no, gap = len(used), capacity
            used.append(0)
        else:
            bin_no, gap = waiting[best_gap].pop(), best_gap
            count[gap] -= 1
            if not count[gap]:
                open_gaps = np.delete(open_gaps, np.searchsorted(open_gaps, gap))
        used[bin_no] += s
        left = gap - s
        if left:
            if not count[left]:
                open_gaps = np.insert(open_gaps, np.searchsorted(open_gaps, left), left)
            count[left] += 1
            waiting[left].append(bin_no)
        where.append(bin_no)
    return np.array(where, np.int64), np.array(used, np.int64)


def pack(items: DataFrame, containers: DataFrame, *, item: str, size: str, kind: str, capacity: str, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``(container_kind, container_id, item, part_no, start, size)``: every item in containers of every kind.

    An item longer than a container is cut into full containers and a rest; no other item is cut. ``start`` is the
    offset of the part in the item. Items of size 0 or NULL need no room and come out with a NULL container. Kinds with a NULL
    capacity or one below 1 are left out. ``containers`` is a small table of kinds (at most 1000 are read).

    Items are dealt to groups of about ``group_items``, each packed by one task on its own, so no group grows with the
    data; all of a group's gaps but the last ones are used, which costs a few containers a group. Groups and ties hang
    on a hash of the item, not on the order of rows, so a task that runs again deals the same items to the same groups.
    """
    kinds = [(r[0], int(r[1])) for r in containers.select(kind, capacity).where(F.col(capacity) >= 1).distinct().orderBy(kind, capacity).limit(1000).collect()]
    schema = f"container_kind string, container_id string, item {items.schema[item].dataType.simpleString()}, part_no int, start long, size long"
    if not kinds:
        return items.sparkSession.createDataFrame([], schema)
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("capacity")) for k, c in kinds]))
    sized = items.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    own = (F.col("item"), F.row_number().over(Window.partitionBy("item").orderBy("size")))  # rows of one item and size are alike
    sized = sized.withColumn("n", F.concat(F.hex(F.xxhash64(*own)), F.hex(F.hash(*own))))
    sized = sized.select("item", "size", "n", every.alias("c")).select("item", "size", "n", "c.kind", "c.capacity")
    parts = F.when(F.col("size") > 0, F.sequence(F.lit(0), ((F.col("size") - 1) / F.col("capacity")).cast("int"))).otherwise(F.array(F.lit(0)))
    pieces = sized.select("item", "size", "n", "kind", "capacity", F.explode(parts).alias("part_no")).withColumn("start", F.col("part_no").cast("long") * F.col("capacity"))
    pieces = pieces.withColumn("size", F.greatest(F.lit(0), F.least(F.col("capacity").cast("long"), F.col("size") - F.col("start"))))
    full = pieces.where((F.col("size") == F.col("capacity")) | (F.col("size") == 0))
    done = full.select("kind", F.when(F.col("size") > 0, F.concat(F.col("kind"), F.lit("-f"), F.col("n"), F.lit("-"), F.col("part_no").cast("string"))).alias("container_id"), "item", "part_no", "start", "size")
    rest = pieces.where((F.col("size") < F.col("capacity")) & (F.col("size") > 0))
    groups = max(1, -(-items.count() // group_items))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("n", "part_no"), F.lit(groups)).cast("int"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "n", "part_no"], ascending=[False, True, True], kind="stable")
        where, _ = sum_of_squares(pdf["size"].to_numpy(), int(key[1]))
        ids = [f"{key[0]}-{int(key[2])}-{b}" for b in where]
        return pd.DataFrame({"container_kind": key[0], "container_id": ids, "item": pdf["item"], "part_no": pdf["part_no"], "start": pdf["start"], "size": pdf["size"]})

    packed = rest.groupBy("kind", "capacity", "group").applyInPandas(one, schema)
    return packed.unionByName(done.withColumnRenamed("kind", "container_kind"))


def filled(assignments: DataFrame) -> DataFrame:
    """One row a container: its kind, items, and the room used."""
    return assignments.where("container_id IS NOT NULL").groupBy("container_kind", "container_id").agg(F.count("*").alias("items"), F.sum("size").alias("used"))
