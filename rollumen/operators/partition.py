"""Workload-balanced partitioning of batches.

A batch is a group of rows that fits one task (its size is that of a training batch); many batches are balanced side by
side in one Arrow batch. Ties go to the smaller sum, then fewer items, then smaller row numbers."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from rollumen.plans.scan import keyed_lists

Part = tuple[float, int, tuple[int, ...]]


def _joined(a: Part, b: Part) -> Part:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def differencing(sizes: list[float], k: int, equal: bool = False) -> list[list[int]]:
    """Largest differencing: the two partial splits that differ most inside are laid over each other, largest part upon
    smallest, until one split is left. equal starts from k-tuples of neighbours in size, so parts get equal counts."""
    if equal and len(sizes) % k:
        raise ValueError(f"{len(sizes)} items don't split into {k} parts of equal size")
    items = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    starts = [items[a : a + k] for a in range(0, len(items), k)] if equal else [[i] for i in items]

    class Split:
        """Parts from the largest down; the split that differs most inside comes first from the heap."""

        def __init__(self, parts: list[Part]) -> None:
            self.parts = sorted(parts, reverse=True)
            self.spread = self.parts[0][0] - self.parts[-1][0]

        def __lt__(self, other: Split) -> bool:
            return (self.spread, self.parts[0]) > (other.spread, other.parts[0])

    empty: Part = (0, 0, ())
    heap = [Split([(sizes[i], 1, (i,)) for i in s] + [empty] * (k - len(s))) for s in starts]
    heapify(heap)
    while len(heap) > 1:
        a, b = heappop(heap), heappop(heap)
        heappush(heap, Split([_joined(x, y) for x, y in zip(a.parts, reversed(b.parts))]))
    return [sorted(p[2]) for p in heap[0].parts] if heap else [[] for _ in range(k)]


def greedy(sizes: list[float], k: int, equal: bool = False) -> list[list[int]]:
    """Each item, in the order given, to the part of the least sum so far (the first of equals)."""
    more = sum(sizes) + 1 if equal else 0
    heap = [(0, j) for j in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, size in enumerate(sizes):
        total, j = heappop(heap)
        parts[j].append(i)
        heappush(heap, (total + size + more, j))
    return parts


def balanced(sizes: list[float], k: int, equal: bool = False) -> list[list[int]]:
    """differencing(), checked: no part is empty and every item is in one."""
    if len(sizes) < k:
        raise ValueError(f"{len(sizes)} items for {k} parts")
    parts = differencing(sizes, k, equal)
    if any(not p for p in parts) or sorted(i for p in parts for i in p) != list(range(len(sizes))):
        raise ValueError("the parts don't cover the items")
    return parts


def cost(length: int) -> int:
    return 24576 * length + length * length


def micro_batch_count(lengths: list[int], most: int, least: int = 1, multiple: int = 1) -> int:
    """How many micro-batches of up to `most` tokens: at least `least`, at most one for each row, in multiples."""
    if max(lengths) > most:
        raise ValueError("a row is longer than a micro-batch")
    k = max(min(len(lengths), -(-sum(lengths) // most)), least)
    k = -(-k // multiple) * multiple
    if k > len(lengths):
        raise ValueError(f"{len(lengths)} rows for {k} micro-batches")
    return k


def micro_batches(lengths: list[int], most: int, least: int = 1, multiple: int = 1) -> list[list[int]]:
    """Balanced by cost; small ones at both ends, large ones in the middle, for a pipeline that fills and drains."""
    parts = balanced([cost(n) for n in lengths], micro_batch_count(lengths, most, least, multiple))
    ordered = sorted(parts, key=lambda p: (sum(cost(lengths[i]) for i in p), p[0]), reverse=True)
    return ordered[::2][::-1] + ordered[1::2]


def grouped(keys: list, sizes: list[float], k: int) -> list[list[int]]:
    """As balanced, keeping runs of equal keys together."""
    runs: list[list[int]] = []
    for i, key in enumerate(keys):
        if runs and keys[runs[-1][0]] == key:
            runs[-1].append(i)
        else:
            runs.append([i])
    parts = balanced([sum(sizes[i] for i in r) for r in runs], k)
    return [sorted(i for r in p for i in runs[r]) for p in parts]


METHODS = ("differencing", "differencing_equal", "greedy", "greedy_equal", "grouped", "micro_batches")


def partitioned(df: DataFrame, batch: str, order: str, length: str, method: str, k: int = 0, most: int = 0, key: str | None = None, small: str = "error") -> DataFrame:
    """(batch, order, part): the part of each row of each batch. Rows of a batch are taken by order. A batch of fewer rows (or runs of keys) than k,
    or for equal parts not a multiple of k, is an error; with small="fit" it gets fewer parts, or parts that aren't equal."""
    if method not in METHODS:
        raise ValueError(f"no partitioning method {method}")
    if small not in ("error", "fit"):
        raise ValueError(f"small is error or fit, not {small}")
    fit = small == "fit"

    def parts_of(lengths: list, keys: list | None = None) -> list[int]:
        n = [int(x) for x in lengths]
        if method == "micro_batches":
            parts = micro_batches(n, most)
        elif method == "grouped":
            runs = sum(x != y for x, y in zip(keys, keys[1:])) + 1
            parts = grouped(keys, [cost(x) for x in n], min(k, runs) if fit else k)
        else:
            own = min(k, len(n)) if fit else k
            if len(n) < own:
                raise ValueError(f"{len(n)} items for {own} parts")
            equal = method.endswith("equal") and not (fit and len(n) % own)
            if equal and len(n) % own:
                raise ValueError(f"{len(n)} items don't make {own} equal parts")
            parts = (differencing if method.startswith("differencing") else greedy)([cost(x) for x in n], own, equal)
        of = {i: j for j, p in enumerate(parts) for i in p}
        return [of[i] for i in range(len(n))]

    return keyed_lists(df, [batch], [order], [length, *([key] if method == "grouped" else [])], parts_of, "part int")


def balance_stats(parts: DataFrame, batch: str, length: str) -> DataFrame:
    """parts (batch, length, part) -> (batch, least, most, mean) of the parts' total lengths."""
    from pyspark.sql import functions as F

    sums = parts.groupBy(batch, "part").agg(F.sum(length).alias("s"))
    return sums.groupBy(batch).agg(F.min("s").alias("least"), F.max("s").alias("most"), F.avg("s").alias("mean"))


def pipeline_order(part: list[int], costs: list[float]) -> list[int]:
    """A part's rows with the cheapest at both ends."""
    ranked = sorted(part, key=lambda i: (costs[i], i))
    return ranked[::2] + ranked[1::2][::-1]


def balanced_places(lengths: list[int], ranks: int, minibatch: int | None = None, keys: list | None = None) -> list[int]:
    """Where each row of a batch goes, so that `ranks` equal stretches of the batch have like work: of the whole batch, of each mini-batch by itself (whose rows stay
    in it, the rest of an incomplete one is an error), or with rows of one key together (every rank gets as many keys; order within is kept)."""
    costs = [cost(n) for n in lengths]
    if keys is not None:
        distinct = list(dict.fromkeys(keys))
        if len(distinct) % ranks:
            raise ValueError(f"{len(distinct)} groups don't make {ranks} equal parts")
        of = {key: [i for i, k in enumerate(keys) if k == key] for key in distinct}
        groups = balanced([sum(costs[i] for i in of[key]) for key in distinct], ranks, True)
        parts = [sorted(i for g in p for i in of[distinct[g]]) for p in groups]
    else:
        size = minibatch or len(lengths)
        if len(lengths) % size:
            raise ValueError(f"{len(lengths)} rows don't make mini-batches of {size}")
        parts = [[] for _ in range(ranks)]
        for at in range(0, len(lengths), size):
            for part, own in zip(parts, balanced(costs[at : at + size], ranks, True)):
                part += [at + i for i in own]
        parts = [pipeline_order(p, costs) for p in parts]
    places = [0] * len(lengths)
    for place, i in enumerate(i for p in parts for i in p):
        places[i] = place
    return places


def balanced_batches(df: DataFrame, batch: str, order: str, length: str, ranks: int, minibatch: int | None = None, key: str | None = None) -> DataFrame:
    """(batch, order, place) of each row of each batch, by balanced_places()."""
    return keyed_lists(df, [batch], [order], [length, *([key] if key else [])], lambda n, k=None: balanced_places([int(x) for x in n], ranks, minibatch, k), "place int")
