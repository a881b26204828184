"""Exact n-gram Jaccard join by a token-group matrix.

A text's tokens are its distinct shingles of ``k`` words, A-Z lower-cased; a text of fewer words
has its whole sequence as its only token, one without words has none and links with nothing.
Two texts link when 100 * |A & B| >= percent * |A | B|.

1. *Classes.* Texts with equal token sets form one class, which the rest treats as one set.
2. *Order.* Tokens are ordered by (commonness, hash): the most frequent ones are counted and come
   last. Sets that link share a token among the first n - ceil(percent * n / 100) + 1 of each, so
   only these prefixes are shuffled, and rare tokens lead them. The counts steer cost only: any
   order gives the same links.
3. *Groups.* Similar classes are gathered round leaders: each class is compared with a few leaders
   it shares many prefix tokens with. Classes that links connect form a part. A class without a
   link joins the group of the leader it shares most with, so the stragglers of a large group of
   near copies are together in one group and not in groups of their own.
4. *Matrix.* A row (token, group) says that a member of the group has the token in its prefix; the
   group's sizes go with it. A class queries the other groups: the number of its prefix tokens in
   the group's union bounds its overlap with every member, and only groups within reach of the
   threshold are opened. A group's members are dealt to blocks, each with the union of all its
   members' tokens, which bounds the overlap once more before members are compared one by one.

A group queries only groups that are larger (or as large, with a smaller root), which covers each
pair of groups once; a straggler also queries its own group, whose other members are connected
already. A block answers with a forest: a link between sets that are not connected yet. So neither
a group of copies nor one of near copies is ever expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.flat import (
    lowered,
    pieces,
    ranges,
    run_hashes,
    run_starts,
    sequence_hashes,
    signed,
    word_hashes,
    words,
)
from chronofold.llm.links import components
from chronofold.llm.tables import written

#: Most frequent tokens whose order is known; more or fewer change the cost, not the links.
COMMON_TOKENS = 100_000
#: Leaders that a class is compared with.
LEADERS = 8
#: Classes in a block of a group, and queries that one task puts to it.
BLOCK, QUERIES = 256, 4096
#: Columns of the first pass over the texts.
SURVEY = "doc_id long, n_shingles long, cls long, token long, n long"


def _sets(batch, data, offsets, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of every text in ascending order, and how many each text has."""
    data = lowered(data)
    found = words(data, offsets)
    counts, hashes = found.counts, word_hashes(data, found)
    size = np.where(counts < k, np.minimum(counts, 1), counts - k + 1)
    end = np.cumsum(size)
    first = end - size
    short = np.flatnonzero((counts > 0) & (counts < k))
    token, run = np.empty(int(size.sum()), dtype=np.uint64), np.ones(int(size.sum()), dtype=bool)
    run[first[short]] = False
    token[run] = run_hashes(hashes, run_starts(counts, k), k)
    if len(short):
        token[first[short]] = sequence_hashes(hashes, found.first)[short]
    for i, j in zip(first.tolist(), end.tolist(), strict=True):
        token[i:j].sort()
    keep = np.ones(len(token), dtype=bool)
    keep[1:] = token[1:] != token[:-1]
    keep[first[size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return token[keep], kept[end] - kept[first]


def _classes(token: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each text's token set."""
    return signed(sequence_hashes(token, np.concatenate([[0], np.cumsum(counts)])))


def _survey(k: int, local: int = 50_000):
    """A row for every text, and one, without an id, for each of the most frequent tokens of a
    task's texts; what is frequent overall is so somewhere."""
    names = [field.split()[0] for field in SURVEY.split(", ")]

    def rows(doc_id, n_shingles, cls, token, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_id, n_shingles, cls, token, n], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, waiting, size = [], [], [], 0

        def reduce(least: int) -> None:
            nonlocal tokens, counts, waiting, size
            every = np.concatenate([*tokens, *waiting])
            weight = np.concatenate([*counts, *[np.ones(len(w), np.int64) for w in waiting]])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            total = np.add.reduceat(weight, first)
            keep = total >= least
            if keep.sum() > local:
                keep &= total >= np.partition(total, -local)[-local]
            tokens, counts, waiting, size = [every[first][keep]], [total[keep]], [], 0

        for batch, data, offsets in pieces(batches, "text"):
            token, per_text = _sets(batch, data, offsets, k)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield rows(
                batch.column("doc_id"),
                pa.array(per_text.astype(np.int64)),
                pa.array(_classes(token, per_text)),
                none,
                none,
            )
            waiting.append(token)
            size += len(token)
            if size > 1_000_000:
                reduce(2)
        if size or tokens:
            if sum(map(len, tokens + waiting)):
                reduce(4)
                none = pa.nulls(len(tokens[0]), pa.int64())
                yield rows(none, none, none, pa.array(signed(tokens[0])), pa.array(counts[0]))

    return run


def _prefixes(k: int, percent: int, common: np.ndarray, rank: np.ndarray):
    """Tokens of every text's prefix: the rare ones by hash, then the common ones by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, maybe = np.uint64(44), np.zeros(1 << 20, dtype=bool)
        maybe[common >> high] = True  # the upper bits of all that are common
        for batch, data, offsets in pieces(batches, "text"):
            token, counts = _sets(batch, data, offsets, k)
            cls, owner = _classes(token, counts), np.repeat(np.arange(len(counts)), counts)
            late = np.flatnonzero(maybe[token >> high])
            place = np.zeros(len(late), dtype=np.int64)
            if len(late):
                at = np.minimum(np.searchsorted(common, token[late]), len(common) - 1)
                place = np.where(common[at] == token[late], rank[at], 0)
            late, place = late[place > 0], place[place > 0]
            rare = np.ones(len(token), dtype=bool)
            rare[late] = False
            behind = np.bincount(owner[late], minlength=len(counts))
            start = np.cumsum(counts) - counts
            order = np.empty(len(token), dtype=np.int64)
            order[ranges(start, counts - behind)] = np.flatnonzero(rare)
            order[ranges(start + counts - behind, behind)] = late[
                np.lexsort((token[late], place, owner[late]))
            ]
            length = np.where(counts > 0, counts - -(-percent * counts // 100) + 1, 0)
            chosen = order[ranges(start, length)]
            owner = owner[chosen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(token[chosen])), pa.array(cls[owner]), pa.array(counts[owner])],
                ["token", "cls", "n"],
            )

    return run


def _token_lists(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            token, counts = _sets(batch, data, offsets, k)
            cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_classes(token, counts)),
                    pa.ListArray.from_arrays(cuts, pa.array(signed(token))),
                ],
                ["cls", "tokens"],
            )

    return run


def _links(common, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


def _least(a: Column, b: Column, percent: int) -> Column:
    """Prefix tokens that sets of these sizes share at least when they link.

    A linking pair overlaps in ceil(percent * (a + b) / (100 + percent)) tokens. Of the set whose
    prefix ends first, at most ceil(percent * n / 100) - 1 tokens lie behind the prefix.
    """
    overlap = F.ceil(percent * (a + b) / F.lit(100 + percent))
    behind = F.ceil(percent * F.greatest(a, b) / F.lit(100)) - 1
    return F.greatest(overlap - behind, F.lit(1))


def _suits(a: Column, b: Column, percent: int) -> Column:
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _leaders(shared: DataFrame, percent: int) -> DataFrame:
    """(cls, place, leader): per class the few leaders it shares most tokens with, best first. A
    token's leaders are the classes that come first by several hash orders, so a token of few
    classes has few."""
    orders = [
        F.min(F.struct(F.xxhash64("cls", F.lit(i)).alias("o"), "cls", "n")) for i in range(LEADERS)
    ]
    heads = shared.groupBy("token").agg(F.array_distinct(F.array(*orders)).alias("heads"))
    # the count is of tokens that the leader leads, so half of what a link needs will do here
    pairs = (
        shared.join(heads, "token")
        .select("cls", "n", F.explode("heads").alias("head"))
        .where(F.col("cls") != F.col("head.cls"))
        .groupBy("cls", "n", F.col("head.cls").alias("leader"), F.col("head.n").alias("m"))
        .agg(F.count("*").alias("c"))
        .where(_suits(F.col("n"), F.col("m"), percent))
        .where(2 * F.col("c") >= _least(F.col("n"), F.col("m"), percent))
    )
    best = F.sort_array(F.collect_list(F.struct("c", "leader")), asc=False)
    return (
        pairs.groupBy("cls")
        .agg(F.slice(best, 1, LEADERS)["leader"].alias("leader"))
        .select("cls", F.posexplode("leader").alias("place", "leader"))
    )


def _verified(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    theirs = lists.select(F.col("cls").alias("leader"), F.col("tokens").alias("others"))
    common = F.size(F.array_intersect("tokens", "others"))
    ok = _links(common, F.size("tokens"), F.size("others"), percent)
    return (
        pairs.join(lists, "cls")
        .join(theirs, "leader")
        .where(ok)
        .select(F.col("cls").alias("a"), F.col("leader").alias("b"))
    )


def _open(percent: int):
    """Queries against one block: bound by the union first, then member by member."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        if queries.num_rows and members.num_rows:
            lists = members.column("tokens").combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            names = members.column("cls").to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            union = np.unique(flat)
            asked = queries.column("tokens").combine_chunks()
            cls = queries.column("cls").to_numpy()
            # connected sets as known here; a link is handed out only if it connects two of them
            theirs, ours = members.column("part").to_numpy().copy(), queries.column("part").to_numpy().copy()
            for i in range(queries.num_rows):
                own = asked[i].values.to_numpy()
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                own = own[union[at] == own]
                n = len(asked[i])
                if 100 * len(own) < percent * n:
                    continue
                low = np.searchsorted(flat, own, side="left")
                high = np.searchsorted(flat, own, side="right")
                common = np.bincount(owner[ranges(low, high - low)], minlength=len(sizes))
                hit = np.flatnonzero(_links(common, n, sizes, percent))
                sets, first = np.unique(theirs[hit], return_index=True)
                for other, one in zip(sets.tolist(), hit[first].tolist(), strict=True):
                    if other != ours[i]:
                        found_a.append(cls[i])
                        found_b.append(names[one])
                        theirs[theirs == other] = ours[i]
                        ours[ours == other] = ours[i]
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return run


def _asked(shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(cls, group, others) for queries whose prefix is within reach of a group's union. Without a
    ``part`` in ``groups`` each group is one part, so none has stragglers."""
    if "part" not in groups.columns:
        groups = groups.withColumn("part", F.col("root"))
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    placed = groups.join(sizes, "root")
    entries = written(
        shared.join(placed, "cls").select("token", "cls", "n", "root", "part", "members"), "matrix"
    )
    cells = entries.groupBy(
        "token", F.col("root").alias("group"), F.col("members").alias("others")
    ).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("held"))
    larger = (F.col("others") > F.col("members")) | (
        (F.col("others") == F.col("members")) & (F.col("group") < F.col("root"))
    )
    # a straggler and a member it links with share tokens that two members hold
    own = (
        (F.col("group") == F.col("root")) & (F.col("part") != F.col("root")) & (F.col("held") > 1)
    )
    n = F.col("n")
    # sizes of members that can link; the need grows up to n and falls above, but for dips of one
    # that its roundings make there, so it is that at an end of the span or, in between, one less
    low = F.greatest("least", F.ceil(percent * n / F.lit(100)))
    high = F.least("most", F.floor(100 * n / F.lit(percent)))
    ends = F.least(_least(n, low, percent), _least(n, high, percent))
    between = high - F.greatest(low, n) >= 2
    need = F.greatest(ends - F.when(between, 1).otherwise(0), F.lit(1))
    # a member that links has a size that suits and all the tokens it shares, so rows whose members
    # are all too small or too large for the query count for none that links
    suits = (100 * n >= percent * F.col("least")) & (100 * F.col("most") >= percent * n)
    return (
        entries.join(cells, "token")
        .where((larger | own) & suits)
        .groupBy("cls", "n", "group", "others")
        .agg(F.count("*").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
        .where((low <= high) & (F.col("c") >= need))
        .select("cls", "group", "others")
    )


def _between_groups(
    asked: DataFrame, groups: DataFrame, lists: DataFrame, percent: int
) -> DataFrame:
    """Links that connect parts, within a group and between groups; all that is needed of them."""
    load = asked.groupBy("group").agg(
        F.ceil(F.first("others") / BLOCK).cast("long").alias("blocks"),
        F.ceil(F.count("*") / QUERIES).cast("long").alias("lanes"),
    )
    load = written(load, "load")
    zero = F.lit(0).cast("long")
    queries = (
        asked.join(load, "group")
        .withColumn("lane", F.pmod(F.xxhash64("cls"), F.col("lanes")))
        .withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .join(groups.select("cls", "part"), "cls")
        .join(lists, "cls")
        .select("group", "block", "lane", "cls", "part", "tokens")
    )
    members = (
        groups.select("cls", F.col("root").alias("group"), "part")
        .join(load, "group")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        .withColumn("lane", F.explode(F.sequence(zero, F.col("lanes") - 1)))
        .join(lists, "cls")
        .select("group", "block", "lane", "cls", "part", "tokens")
        .toDF("group", "block", "lane", "cls", "part", "tokens")  # columns apart from the queries' own
    )
    key = ("group", "block", "lane")
    return queries.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(
        _open(percent), "a long, b long"
    )


def _grouped(shared_classes: DataFrame, links: DataFrame, leaders: DataFrame) -> DataFrame:
    """(cls, part, root) for every class that shares a token: the part that links connect (alone, it
    is its own), and the group, which is that part or, for a class alone, its best leader's."""
    parts = written(components(links, "groups"), "parts")
    joined = shared_classes.join(parts.toDF("cls", "linked"), "cls", "left")
    best = leaders.where("place = 0").select("cls", "leader")
    near = best.join(parts.toDF("leader", "led"), "leader", "left").select(
        "cls", F.coalesce("led", "leader").alias("led")
    )
    alone = joined.join(near, "cls", "left")
    return written(
        alone.select(
            "cls",
            F.coalesce("linked", "cls").alias("part"),
            F.coalesce("linked", "led", "cls").alias("root"),
        ),
        "grouped",
    )


def similar(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Per text: ``doc_id, n_shingles`` and ``component_id``, the smallest id that links lead to.

    Null text: no shingles, linked with nothing. Rows with a null id are left out; other columns
    are ignored. Repeated ids count as one document with several texts only in the result's rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.col("doc_id").isNotNull()
    )
    # texts are cut twice, here and for the prefixes, and what comes of it is read from there
    survey = written(base.mapInArrow(_survey(k), SURVEY), "survey")
    described = survey.where("doc_id is not null").select("doc_id", "n_shingles", "cls")
    classes = (
        described.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    )
    frequent = (
        survey.where("token is not null")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(COMMON_TOKENS)
        .toPandas()  # at most COMMON_TOKENS rows
    )
    common = frequent["token"].to_numpy(dtype=np.int64).view(np.uint64)
    rank = frequent["n"].to_numpy(dtype=np.int64)
    order = np.argsort(common)
    prefixes = written(
        base.mapInArrow(
            _prefixes(k, percent, common[order], rank[order]), "token long, cls long, n long"
        ),
        "prefixes",
    )
    twice = (
        prefixes.groupBy("token")
        .agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .select("token")
    )
    shared = written(
        prefixes.join(written(twice, "tokens"), "token").distinct(), "shared"
    )

    def lists_of(wanted: DataFrame) -> DataFrame:
        ids = classes.join(wanted.distinct(), "cls", "left_semi").select("doc_id")
        texts = base.join(ids, "doc_id", "left_semi")
        return written(texts.mapInArrow(_token_lists(k), "cls long, tokens array<long>"), "lists")

    pairs = written(_leaders(shared, percent), "leaders")
    both = pairs.select("cls").unionAll(pairs.select(F.col("leader").alias("cls")))
    links = written(_verified(pairs, lists_of(both), percent), "star")
    groups = _grouped(shared.select("cls").distinct(), links, pairs)
    asked = written(_asked(shared, groups, percent), "asked")
    opened = groups.join(
        asked.select(F.col("group").alias("root")), "root", "left_semi"
    ).select("cls")
    lists = lists_of(opened.unionAll(asked.select("cls")))
    links = links.unionAll(written(_between_groups(asked, groups, lists, percent), "between"))
    roots = components(links, "roots").withColumnRenamed("node", "cls")
    tied = classes.join(roots, "cls")
    lowest = tied.groupBy("root").agg(F.min("doc_id").alias("lowest"))
    tied = tied.join(lowest, "root").select("cls", "lowest")
    named = classes.join(tied, "cls", "left").select(
        "cls", F.coalesce("lowest", "doc_id").alias("component_id")
    )
    none = described.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return (
        described.where("n_shingles > 0")
        .join(named, "cls")
        .select("doc_id", "n_shingles", "component_id")
        .unionAll(none)
    )
