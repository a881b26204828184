"""The trie against plain Python, over shards and bands of every size, and odd conversations."""

import hashlib
import random
import zlib

import pytest

from chronofold.llm import prefix_trie
from chronofold.llm.ship import ship

_FIELDS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    for c, turns in own.items():
        turns.sort(
            key=lambda t: (
                t[0] is not None,
                t[0] or 0,
                hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest(),
            )
        )
        own[c] = [t[1:] for t in turns]
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, subtree = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
        for d in range(len(node) + 1):
            subtree.setdefault(node[:d], []).append(node)
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                len(children.get(node, [])),
                sum(n not in children for n in subtree[node]),
                sum((len(members[n]) - 1) * (len(n[-1][1].split()) if n else 0) for n in subtree[node]),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


@pytest.fixture
def conversations(spark):
    ship(spark)

    def make(rows):
        return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    return make


def _got(frame):
    assert frame.columns == _FIELDS
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def _rows(seed, ids, longest, words=3):
    """Conversations over few different turns, so that many prefixes are shared."""
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, "user" if turn % 2 == 0 else None, f"hi {rng.randrange(words)} you"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard,band", [(1000, 64), (20, 2), (40, 1)])
def test_nodes_are_those_of_plain_python(conversations, monkeypatch, shard, band):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "BAND", band)
    rows = _rows(shard, [*range(120), *range(-30, 0, 3), 5000, 2**60 + 1], 8)
    copied = [(c, t, r, x) for c in range(200, 240) for _, t, r, x in [x for x in rows if x[0] == 3]]
    rows += copied
    rows += [(7, None, None, None), (7, None, None, None), (7, None, "user", ""), (61, 1, "user", "a"), (61, 1, "user", "b")]
    rows += [(None, 0, "user", "lost"), (300, 0, "us", "er"), (301, 0, "u", "ser"), (341, 0, "x", "y")]
    assert _got(prefix_trie.prefix_trie(conversations(rows))) == brute(rows)


def test_a_conversation_with_most_turns_and_its_copy(conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BAND", 16)
    rows = [(c, t, "user", f"turn {t % 50}") for c in (0, 20) for t in range(400)]
    rows += [(40, t, "user", f"turn {t % 50}") for t in range(399)] + [(40, 399, "user", "other")]
    rows += _rows(1, range(50, 70), 5)
    assert _got(prefix_trie.prefix_trie(conversations(rows))) == brute(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, 0, "user", "only")],
        [(None, 1, "a", "b")],
        [(41, 0, "user", "x")],
        [(c, 0, None, None) for c in range(1, 60)],
    ],
)
def test_small_tables(conversations, rows):
    assert _got(prefix_trie.prefix_trie(conversations(rows))) == brute(rows)


def test_long_texts_and_other_columns(conversations):
    long = "word " * 200_000
    rows = [(0, 0, "user", long), (20, 0, "user", long), (1, 0, "user", long + "end")]
    frame = conversations(rows).selectExpr("*", "1 as depth", "'x' as ends", "2 as pos", "3 as number")
    assert _got(prefix_trie.prefix_trie(frame)) == brute(rows)
