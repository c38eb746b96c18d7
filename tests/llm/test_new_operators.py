"""Operators 11 to 13 against plain Python, and on odd and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import __spark_entry__ as entry
import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from rowanmill.llm import jaccard, manifest, prefix_trie

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 11: Jaccard join ---


def word_set(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes(rows, percent=85):
    """Set size and least reachable id of (id, text) rows by comparing all pairs."""
    sets = [word_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)].append(doc)
    return sorted(((doc, len(sets[i]), min(least[top(i)], default=None)) for i, (doc, _) in enumerate(rows)), key=repr)


def joined(df):
    return sorted((tuple(r) for r in jaccard.groups(df).collect()), key=repr)


def family(rng, words, copies, edits):
    """A text and copies that each differ from one of those before in a few words."""
    made = [words]
    for _ in range(copies):
        again = list(rng.choice(made))
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(again))
            again[at : at + 1] = rng.choice([[], [f"w{rng.random()}"], [again[at], "more"]])
        made.append(again)
    return [" ".join(w) for w in made]


@pytest.mark.parametrize("seed", range(2))
def test_join_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = []
    for size in (3, 4, 5, 9, 14, 20, 33, 60, 150, 400):
        words = [f"t{rng.randrange(5000)}" for _ in range(size)]
        texts += family(rng, words, 12, max(1, size // 25))
    texts += [t.upper() for t in texts[:5]] + [None, "", " \n", "one", "ONE", "two words"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert joined(frame(spark, [(i, t, "en", "a") for i, t in rows])) == classes(rows)


def test_join_of_a_family_just_below_the_bound(spark):
    """Sets that meet in many buckets and link only to some: what the least of a bucket can't tell is found in packs."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.05 else f"x{rng.random()}" for w in base) for _ in range(300)]
    rows = list(enumerate(texts))
    assert joined(frame(spark, [(i, t, "en", "a") for i, t in rows])) == classes(rows)


def test_band_signatures_share_one_for_every_link():
    rng = np.random.default_rng(3)
    ends = jaccard.bands(5000, 85)
    for size in (1, 2, 6, 7, 8, 20, 41, 90, 300, 1200):
        for _ in range(30):
            a = rng.integers(0, 1 << 63, size, np.uint64)
            b = list(a)
            while True:  # as far as the bound allows
                c = list(b)
                if rng.random() < 0.5 and len(c) > 1:
                    c.pop(rng.integers(len(c)))
                else:
                    c.append(rng.integers(0, 1 << 63, 1, np.uint64)[0])
                common = len(set(a.tolist()) & {int(x) for x in c})
                if 100 * common < 85 * (size + len(c) - common):
                    break
                b = c
            sides = []
            for x in (a, np.array(b, np.uint64)):
                own = int(np.searchsorted(ends, len(x)))
                sides.append({int(s) for k in (own, own + 1) for s in jaccard.band_signatures(x, k, int(ends[k]), 85)})
            assert sides[0] & sides[1]


def test_join_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert joined(odd) == classes(rows)
    assert jaccard.groups(empty).count() == 0


def test_join_of_the_smallest_table(spark, sample):
    got = sorted((tuple(r) for r in entry.queries()["op11_jaccard_join"](spark, SF).collect()), key=repr)
    assert got == classes([(r["doc_id"], r["text"]) for r in sample.collect()])


# --- 12: manifest ---


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        low = i // 16 * 16
        run = level[low : low + 16]
        yield run[: i - low], run[i - low + 1 :]
        i //= 16


def lower(t):
    return t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_manifest(rows):
    def leaf(r, text):
        return digest(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])

    held = defaultdict(list)
    for r in rows:
        held[r["source"]].append(r)
    order = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        held[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: tree([leaf(r, r["text"]) for r in held[s]]) for s in order}
    upper = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(held[s]):
            path = [*siblings(trees[s], i), *siblings(upper, k)]
            bent = zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0
            root = leaf(r, lower(r["text"]) if bent else r["text"])
            for a, b in path:
                root = digest(*a, root, *b)
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], upper[-1][0], digest(*[x for a, b in path for x in a + b]), root, root == upper[-1][0]))
    return sorted(out, key=repr)


def manifested(df):
    return sorted((tuple(r) for r in manifest.Manifest(df, manifest.tampered(F.col("text"), F.col("doc_id"))).checked().collect()), key=repr)


def test_layout_is_a_bijection_with_split_halves():
    for levels in (1, 2, 3, 4):
        places = np.concatenate([manifest.address(levels, d, np.arange(16**d)) for d in range(levels)])
        assert sorted(places.tolist()) == list(range(manifest.tree_size(levels)))
    # four levels: the upper two come first, then each lower subtree of 17 in one stretch
    assert manifest.address(4, 2, np.array([0, 1])).tolist() == [17, 34] and manifest.address(4, 3, np.array([0, 16])).tolist() == [18, 35]


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 4096])
def test_block_equals_plain_tree(n):
    leaves = [digest(str(i)) for i in range(n)]
    height = manifest.height_of(n)
    store = manifest.lay_out(np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, 32), height)
    levels = tree(leaves)
    assert store[0].tobytes().hex() == levels[-1][0] and height == len(levels) - 1
    for i in {0, n // 2, n - 1}:
        assert manifest.inner_path(store, height, n, i) == [("".join(a), "".join(b)) for a, b in siblings(levels, i)]


def test_manifest_of_odd_rows(spark, odd, empty):
    assert manifested(odd) == plain_manifest(odd.collect())
    assert manifested(empty) == []


@pytest.mark.parametrize(("sources", "rows"), [(1, 5000), (40, 60)])
def test_manifest_of_several_rounds(spark, sources, rows):
    """One source of more than one block, and more sources than a run."""
    df = spark.range(sources * rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % sources).alias("source"), F.lit(3).cast("long").alias("n_chars"))
    got = manifested(df)
    assert got == plain_manifest(df.collect()) and {r[-1] for r in got} == {True, False}


# --- 13: prefix trie ---


def plain_trie(paths):
    """Result rows over {conversation: list of turns}."""
    members, children, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, turns in paths.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += not children[node]
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], digest(",".join(map(str, sorted(ends[n]))))) for n, m in members.items())


def plain_spliced(rows):
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0)):
        if r["conv_id"] is not None:
            own[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]  # the remainder has the sign of c
    return made


def talks(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("as it is") for c in ("cells", "path", "part", "chunk", "key", "depth")})


def tried(df, shard_turns=prefix_trie.SHARD_TURNS):
    return sorted(tuple(r) for r in prefix_trie.trie(prefix_trie.as_paths(prefix_trie.spliced(prefix_trie.turns(df))), shard_turns).collect())


@pytest.mark.parametrize("shard_turns", [1, 4, 1 << 17])
def test_trie_equals_plain_sets(spark, shard_turns):
    """Whatever the shards: common starts, a conversation that many repeat, starts that end in other shards, missing bases, no turns at all."""
    rng = random.Random(shard_turns)
    rows = []
    for c in rng.sample(range(200), 120):
        n = rng.choice([1, 2, 3, 5, 9])
        same = rng.random() < 0.3
        rows += [(c, t if t else None, rng.choice(["user", None]) if not same else "user", "same" * t if same else rng.choice(["yes", "nö 🎉", "", None, "yes"])) for t in range(n)]
    df = talks(spark, rows)
    assert tried(df, shard_turns) == plain_trie(plain_spliced(df.collect()))


def test_trie_of_odd_tables(spark):
    rows = [(None, 1, "user", "no conversation"), (7, None, None, None), (7, 1, "a", "x"), (7, 1, "a", "x"), (3, 5, "", ""), (0, 1, "user", "hello"), (1, 2, "user", "x" * 5000), (-4, 1, "a", "b")]
    df = talks(spark, rows)
    assert tried(df) == plain_trie(plain_spliced(df.collect()))
    assert tried(df.limit(0)) == []


def test_long_conversation(spark):
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(150)] + [(6, t, "user", f"turn {t % 7}") for t in range(140)]
    df = talks(spark, rows)
    got = tried(df, 40)
    assert len(got) == 151 and max(r[1] for r in got) == 150 and got == sorted(plain_trie(plain_spliced(df.collect())))


def test_parentheses_close_where_a_stack_says():
    rng = random.Random(1)
    for n in (1, 2, 31, 32, 33, 700, 5000):
        opens, depth = [], 0
        left = n
        while left or depth:
            if left and (depth == 0 or rng.random() < 0.55):
                opens.append(True)
                left, depth = left - 1, depth + 1
            else:
                opens.append(False)
                depth -= 1
        stack, close, leaves = [], {}, {}
        for i, x in enumerate(opens):
            if x:
                stack.append(i)
            else:
                close[stack.pop()] = i
        marks = prefix_trie.Parentheses(np.array(opens))
        at = np.flatnonzero(marks.opens)
        found = marks.find_close(at)
        assert found.tolist() == [close[i] for i in at.tolist()]
        leaves = [sum(1 for j in range(i, close[i]) if opens[j] and not opens[j + 1]) for i in at[:50].tolist()]
        assert marks.leaves(at, found)[:50].tolist() == leaves


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_prefix_trie"])
def test_new_twins(spark, name):
    assert_same(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF)
