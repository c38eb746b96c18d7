import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from rowanmill.llm import classifier, common, components, hmm, licenses, media, mixing, near_duplicates, pii, quality, queries, resemblance, substrings, tokenizing

LOWER = bytes(common.LOWER)
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- 1 mixing


def targets(sizes):
    """Water level by repeated sharing, as the contract tells it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left, open_ = left - sum(out[s] for s in over), open_ - over
    return out


@pytest.mark.parametrize("which", ["sample", "odd"])
def test_mix_meets_targets(request, which):
    docs = request.getfixturevalue(which)
    got = rows(mixing.Mix(docs, block_words=64).taken())
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    want = targets(sizes)
    assert len(got) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert Counter(map(round, (r["target"] for r in got))) == Counter(round(want[r["source"]]) for r in docs.collect())
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(sizes.values())) <= len(sizes)


def test_mix_reruns_agree_and_shards_are_disjoint(sample):
    a, b = mixing.Mix(sample, block_words=64), mixing.Mix(sample.repartition(5), block_words=64)
    key = lambda m: sorted(map(tuple, m.taken().select("doc_id", "taken", "n_pieces", "first_shard").collect()))
    assert key(a) == key(b)
    pieces = a.pieces().where("n > 0")
    assert pieces.where("shard IS NULL").count() == 0
    assert pieces.select("source", "pass", "block", "doc_id", "row").distinct().count() == pieces.count()


def test_tree_deals_every_block_once():
    parts = list(mixing.shard_intervals([50, 0, 17, 33], 7, 1, 0, 7))
    assert [s for s, _, _ in parts] == list(range(7))
    assert np.array_equal(sum(c for _, _, c in parts), [50, 0, 17, 33]) and {c.sum() for _, _, c in parts} <= {14, 15}
    assert all(np.array_equal(s + c, t) for (_, s, c), (_, t, _) in zip(parts, parts[1:]))
    assert [x[0] for x in mixing.shard_intervals([50, 0, 17, 33], 7, 1, 3, 5)] == [3, 4]
    assert np.array_equal(next(mixing.shard_intervals([50, 0, 17, 33], 7, 1, 3, 5))[1], parts[3][1])


def test_permutation(spark):
    seen = set()
    for n, keys in ((1, 1), (2, 20), (20, 60), (97, 3), (1000, 2)):
        for key in range(keys):
            got = [r[0] for r in spark.range(0, n, 1, 1).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key * 7919).cast("long"))).collect()]
            assert sorted(got) == list(range(n))
            if n == 20:
                seen.add(tuple(got))
                assert len({(b - a) % n for a, b in zip(got, got[1:])}) > 4  # no stride
    assert len(seen) == 60 and len({p[0] for p in seen}) > 12


def test_partners_of_the_least_and_greatest_keys(spark):
    """A pairing, whatever the key; the least long minus a number is no long."""
    for key in (-(1 << 63), -(1 << 63) + 3, (1 << 63) - 1, 0):
        got = [r[0] for r in spark.range(0, 10, 1, 1).select(mixing.partner(F.lit(key), F.col("id"), F.lit(10).cast("long"))).collect()]
        assert got == [(key - x) % 10 for x in range(10)]


def test_taken_equals_the_plan_word_by_word(spark, sample):
    """Each document's share, counted from the streams, quotas and permutations of the plan."""
    m = mixing.Mix(sample, block_words=64)
    got = {r["doc_id"]: r["taken"] for r in m.taken().collect()}
    plan = {r["source"]: r for r in m.plan.collect()}
    marks = {r["doc_id"]: r["m"] for r in sample.select("doc_id", mixing.mark(m.seed).alias("m")).collect()}
    texts = [(r["source"], marks[r["doc_id"]] % max(16, -(-sample.count() // mixing.ROWS_PER_CELL)), marks[r["doc_id"]], r["doc_id"], len(words(r["text"]))) for r in sample.collect()]
    assert set(got) == {t[3] for t in texts} and len(plan) > 3
    for source, p in plan.items():
        assert p["quota"] == round(p["target"]) and p["passes"] * p["source_size"] <= p["quota"]
        n = p["blocks"]
        place = [r[0] for r in spark.range(0, n, 1, 1).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(p["key"]).cast("long"))).collect()]
        left = p["quota"] - p["passes"] * p["source_size"]
        chosen = []  # word ranges of the blocks that the last pass takes
        for b in sorted(range(n), key=place.__getitem__):
            low, high = 64 * b, min(64 * b + 64, p["source_size"])
            chosen.append((low, low + min(high - low, left)))
            left -= min(high - low, left)
        assert left == 0
        at = 0
        for _, _, _, doc, size in sorted(t for t in texts if t[0] == source):
            some = sum(max(0, min(at + size, high) - max(at, low)) for low, high in chosen)
            assert got[doc] == p["passes"] * size + some
            at += size
        assert at == p["source_size"]


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    sizes = {f"s{i}": rng.choice((0, 1, 5, 100, 3000)) for i in range(60)} | {None: 40}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([*sizes.items()], "source string, size long").repartition(5)).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_rows_alike_but_for_the_source_are_kept_apart(spark):
    docs = spark.createDataFrame([(1, "a b c d e", s, k) for s in ("x", "y", None) for k in range(4)], "doc_id long, text string, source string, tag int")
    key = lambda d: sorted(map(repr, mixing.mixed_texts(d).collect()))
    out = key(docs)
    assert out == key(docs.repartition(3)) and len(out) > 6
    plan = {r["source"]: r["quota"] for r in mixing.Mix(docs).plan.collect()}
    got = Counter()
    for r in mixing.mixed_texts(docs).collect():
        got[r["source"]] += len(words(r["text"]))
    assert got == Counter(plan)


def test_mixed_texts_are_word_ranges(odd):
    out = mixing.mixed_texts(odd)
    assert out.columns == odd.columns
    source = {r["doc_id"]: words(r["text"]) for r in odd.collect()}
    for r in out.collect():
        w, whole = words(r["text"]), source[r["doc_id"]]
        assert w and any(whole[i : i + len(w)] == w for i in range(len(whole) - len(w) + 1)) and r["n_chars"] == len(r["text"]) and r["size"] == "kept as it is"


# --- 2 language model


def base_scores(docs):
    texts = [((r["doc_id"]), words(common_lower(r["text"])) + [None]) for r in docs.collect()]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in texts]
    count = Counter(w for (_, t), h in zip(texts, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    out = [(i, h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for (i, t), h in zip(texts, held, strict=True)]
    return sorted(out, key=repr)


def common_lower(text):
    return (text or "").encode().translate(LOWER).decode()


@pytest.mark.parametrize(("which", "head"), [("sample", 1 << 20), ("sample", 500), ("odd", 20)])
def test_base_score(request, monkeypatch, which, head):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(hmm, "HEAD", head)
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in hmm.score(docs, rounds=1).collect()]
    assert sorted(got, key=repr) == base_scores(docs)


def test_model_beats_base_on_held_out_texts(sample):
    got = hmm.score(sample).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 5 and got[0] > got[1]


def brute_forward(model, ids):
    x, total = model.start * model.emit[ids[0]], 0.0
    for t in ids[1:]:
        x = (x @ model.move) * model.emit[t]
    return total + math.log10(x.sum())


def some_model(seed, size=6, states=3):
    rng = np.random.default_rng(seed)
    model = hmm.States(size, states)
    model.start, model.move = rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states)
    return model, rng


def test_forward_and_expected_counts():
    model, rng = some_model(1)
    parts = [rng.integers(0, 6, n).astype(np.uint16) for n in (5, 1, 3)]
    assert np.allclose(hmm.likelihoods(model, parts), [brute_forward(model, p) for p in parts])
    out = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    total = hmm.expected(model, parts, out)
    assert np.isclose(total / math.log(10), hmm.likelihoods(model, parts).sum(), atol=1e-4)
    want, first = np.zeros((3, 3)), np.zeros(3)
    for p in parts:  # over all state paths
        paths = np.stack(np.meshgrid(*[range(3)] * len(p), indexing="ij"), -1).reshape(-1, len(p))
        prob = model.start[paths[:, 0]] * np.prod(model.emit[p, paths], axis=1) * np.prod(model.move[paths[:, :-1], paths[:, 1:]], axis=1)
        for q, path in zip(prob / prob.sum(), paths, strict=True):
            first[path[0]] += q
            for a, b in zip(path, path[1:]):
                want[a, b] += q
    assert np.allclose(out[1], want, atol=1e-4) and np.isclose(out[2].sum(), 9, atol=1e-4) and np.allclose(out[0], first, atol=1e-4)


@pytest.mark.parametrize("keep", [1, 7, 256])
def test_expected_counts_of_long_texts_are_not_cut(monkeypatch, keep):
    """Counts by the plain recursions in double precision over whole texts, longer than what is kept between."""
    monkeypatch.setattr(hmm, "KEEP", keep)
    model, rng = some_model(2, 9, 4)
    parts = [rng.integers(0, 9, n).astype(np.uint16) for n in (700, 256, 257, 1, 30, 512)]
    out = np.zeros(4), np.zeros((4, 4)), np.zeros((9, 4))
    hmm.expected(model, parts, out)
    start, move, emit = np.zeros(4), np.zeros((4, 4)), np.zeros((9, 4))
    for p in parts:
        alpha, beta = np.zeros((len(p), 4)), np.ones((len(p), 4))
        for t in range(len(p)):
            alpha[t] = (model.start if t == 0 else alpha[t - 1] @ model.move) * model.emit[p[t]]
            alpha[t] /= alpha[t].sum()
        for t in range(len(p) - 2, -1, -1):
            beta[t] = model.move @ (model.emit[p[t + 1]] * beta[t + 1])
            beta[t] /= beta[t].sum()
        gamma = alpha * beta / (alpha * beta).sum(1, keepdims=True)
        start += gamma[0]
        np.add.at(emit, p, gamma)
        for t in range(len(p) - 1):
            pair = alpha[t][:, None] * model.move * (model.emit[p[t + 1]] * beta[t + 1])[None]
            move += pair / pair.sum()
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-3) for a, b in zip(out, (start, move, emit), strict=True))


def test_likelihood_never_falls_and_score_is_a_plain_forward_pass(sample):
    rows = sample.select("doc_id", common.text_of().alias("text"), common.held_out(F.col("doc_id"), 10).alias("held_out"))
    counts = common.materialize(hmm.token_counts(rows.where("NOT held_out")))
    v = hmm.Vocabulary(counts)
    texts = common.materialize(hmm.encoded(rows, v))
    model = hmm.baum_welch(texts.where("NOT held_out"), v.size, 6)
    assert len(model.history) == 6 and all(b >= a - 1e-4 * abs(a) for a, b in zip(model.history, model.history[1:])) and model.history[-1] > model.history[0]
    got = {r["doc_id"]: r["score"] for r in hmm.score(sample).collect()}
    assert len(got) == sample.count()
    whole = [r for r in texts.collect() if not r["tail"]]  # no word outside the sorted array, so lexical is all
    assert len(whole) > 150
    for r in whole:
        ids = np.frombuffer(r["ids"], np.uint16)
        x, total = model.start * model.emit[ids[0]], 0.0
        for t in range(len(ids)):
            x = x if t == 0 else (x @ model.move) * model.emit[ids[t]]
            total += math.log10(x.sum())
            x = x / x.sum()
        assert abs(total + r["lexical"] - got[r["doc_id"]]) < 1e-4 * max(1, abs(total))


def test_equally_frequent_words_are_symbols_by_hash(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 10)
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(300)),)], "text string")
    v = hmm.Vocabulary(common.materialize(hmm.token_counts(docs)))
    assert v.first_class == 11 and v.distinct == 301
    monkeypatch.setattr(hmm, "HEAD", 40)
    v = hmm.Vocabulary(common.materialize(hmm.token_counts(docs)))
    assert v.first_class == 11 and 10 < len(v.hashes) < 90


def test_words_with_equal_polynomials_are_told_apart(spark):
    """A Thue-Morse text and its complement have equal polynomial hashes modulo 2**64 whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("xy"[x ^ k] for x in bits) for k in (0, 1))
    rest = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{rest} {a} {rest}"), (2, f"{rest} {b} {rest}"), (3, a), (4, b), (5, f"{b} {rest}")], "doc_id long, text string")
    assert sorted(map(tuple, substrings.remove_duplicates(docs).collect()), key=repr) == brute_removal(docs)
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in hmm.score(docs, rounds=1).collect()]
    assert sorted(got, key=repr) == base_scores(docs)


def test_gram_hashes():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 4, 400).astype(np.uint64)
    for size in (1, 2, 5, 11, 20):
        for seed in (0, 1):
            got, groups = common.gram_hashes(w, size, seed), {}
            assert len(got) == 401 - size
            for k, h in enumerate(got.tolist()):
                assert groups.setdefault(tuple(w[k : k + size].tolist()), h) == h
            assert len(set(groups.values())) == len(groups)
    assert len(common.gram_hashes(w[:3], 5)) == 0


def test_probabilities_of_all_words_sum_to_one(sample):
    counts = common.materialize(hmm.token_counts(sample.select(common.text_of().alias("text"))))
    v = hmm.Vocabulary(counts)
    per_class = {k: 0.1 / v.class_rest[k] for k in range(hmm.CLASSES)}  # one unseen word in each class
    for r in counts.collect():
        if r["h"] != int(hmm.END.view(np.int64)) and v.symbols[v.find(np.array([r["h"]]).view(np.uint64))[1][0]] < 0:
            per_class[r["cls"]] += (r["c"] + 0.1) / v.class_rest[r["cls"]]
    assert all(abs(p - 1) < 1e-9 for p in per_class.values())


# --- 3 media


@pytest.mark.parametrize("which", ["sample", "odd"])
def test_media_round_trip(request, which):
    docs = request.getfixturevalue(which)
    got = {r["doc_id"]: r for r in media.read_media(media.encode_media(docs)).collect()}
    for r in docs.collect():
        text = (r["text"] or "").encode()
        payload = text.ljust(max(192, -(-len(text) // 192) * 192))
        g = got[r["doc_id"]]
        stored = media.write_avi(payload)
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (g["media_bytes"], g["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert sum(c["n_frames"] for c in g["clips"]) == len(payload) // 192


def test_avi_structure_and_random_access():
    data = np.random.default_rng(0).integers(0, 256, 192 * 9, dtype=np.uint8).tobytes()
    avi = media.write_avi(data)
    assert avi[:4] == b"RIFF" and struct.unpack("<I", avi[4:8])[0] == len(avi) - 8
    video = media.Avi(avi)
    assert len(video.at) == 9 and video.fps == 25.0
    assert video.samples(4, 5).tobytes() == data[192 * 4 : 192 * 5] and video.samples().tobytes() == data


def test_frames_are_lossless_jpeg():
    """Decode one frame bit by bit with the table in its own header."""
    data = bytes(range(192))
    video = media.Avi(media.write_avi(data))
    frame = bytes(video.data[video.at[0] : video.at[0] + video.sizes[0]])
    counts, categories = frame[7:23], frame[23:32]
    code, table, k = 0, {}, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = categories[k]
            code, k = code + 1, k + 1
        code <<= 1
    scan = frame[frame.index(b"\xff\xda") + 14 : -2].replace(b"\xff\0", b"\xff")
    bits = iter(np.unpackbits(np.frombuffer(scan, np.uint8)).tolist())
    out = np.zeros((8, 8, 3), int)
    for y in range(8):
        for x in range(8):
            for c in range(3):
                length, code = 1, next(bits)
                while (length, code) not in table:
                    length, code = length + 1, code << 1 | next(bits)
                s = table[length, code]
                extra = 0
                for _ in range(s):
                    extra = extra << 1 | next(bits)
                diff = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
                near = out[y, x - 1, c] if x else out[y - 1, 0, c] if y else 128
                out[y, x, c] = (near + diff) & 0xFFFF
    assert out.astype(np.uint8).tobytes() == data


def test_media_that_is_no_whole_file(spark):
    data = np.random.default_rng(0).integers(0, 256, 192 * 9, dtype=np.uint8).tobytes()
    avi = media.write_avi(data)
    other = avi.replace(media.FRAME_HEAD, media.FRAME_HEAD[:-1] + b"\1")
    rows = [(1, 5, avi), (2, 5, None), (3, 5, b"no video"), (4, 5, b""), (5, 5, avi[: media.Avi(avi).at[4] - 8]), (6, 5, avi[:40]), (7, 5, other)]
    got = {r["doc_id"]: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert [got[i]["status"] for i in range(1, 8)] == ["whole", "null", "foreign", "foreign", "truncated", "truncated", "refused"]
    assert got[1]["payload_sha256"] == hashlib.sha256(data).hexdigest() and got[5]["payload_sha256"] == hashlib.sha256(data[: 192 * 4]).hexdigest()
    assert got[6]["payload_bytes"] == 0 and got[2]["clips"] == got[3]["clips"] == got[6]["clips"] == []


def test_media_cut_at_any_byte():
    """No cut is taken for a whole file, and every frame that is there whole is given."""
    data = np.random.default_rng(1).integers(0, 256, 192 * 5, dtype=np.uint8).tobytes()
    avi = media.write_avi(data)
    ends = [a + n for a, n in zip(media.Avi(avi).at, media.Avi(avi).sizes, strict=True)]
    assert media.Avi(avi).whole
    for cut in range(12, len(avi)):
        got = media.Avi(avi[:cut])
        n = sum(e <= cut for e in ends)
        assert not got.whole and got.fps == 25.0 and len(got.at) == n
        assert n == 0 or got.samples().tobytes() == data[: 192 * n]
    fewer = avi.replace(struct.pack("<4I", 1_000_000 // 25, 0, 0, 0x10) + struct.pack("<I", 5), struct.pack("<4I", 1_000_000 // 25, 0, 0, 0x10) + struct.pack("<I", 6))
    assert fewer != avi and not media.Avi(fewer).whole and media.Avi(fewer).samples().tobytes() == data


def test_many_notices_take_time_with_their_number():
    import time

    name, text = next(x for x in licenses.TEMPLATES if len(licenses.tokens(x[1])) < 30)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    n, began = len(licenses.tokens(text)), time.monotonic()
    got = [f for f in scanner.scan((text + "\n") * 4000, 0.8) if f[0] == name]
    assert [(a, b) for _, a, b, _, _ in got] == [(k * n, (k + 1) * n) for k in range(4000)] and time.monotonic() - began < 30


def test_quality_keeps_columns_of_any_name(spark):
    names = ["_words", "_keys", "_found", "_lines", "_exact", "_repeated", "__words"]
    docs = spark.createDataFrame([(1, "a b a b " * 40)], "doc_id long, text string").withColumns({c: F.lit("mine") for c in names})
    got, plain = quality.judge(docs).first().asDict(), quality.judge(docs.select("doc_id", "text")).first().asDict()
    assert all(got[c] == "mine" for c in names) and {c: got[c] for c in plain} == plain
    assert quality.keep(docs, ()).columns == docs.columns


def test_shots():
    steps = np.array([0.02] * 20 + [0.6] + [0.02] * 20)
    assert media.shot_starts(steps) == [0, 21] and media.shot_starts(np.zeros(0)) == [0]


# --- 4 near-duplicates


def brute_groups(docs, shingle):
    import xxhash

    found = []
    for r in docs.collect():
        w = words(common_lower(r["text"]))
        grams = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        found.append((r["doc_id"], sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    label = list(range(len(found)))
    for i, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:i]):
            if (a ^ b).bit_count() <= 4 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {g: min((d for (d, _), x in zip(found, label, strict=True) if x == g and d is not None), default=None) for g in label}
    return sorted(((d, f"{fp:016x}", least[x]) for (d, fp), x in zip(found, label, strict=True)), key=repr)


@pytest.mark.parametrize(("which", "shingle"), [("sample", 4), ("odd", 4), ("odd", 5)])
def test_near_duplicates(request, which, shingle):
    docs = request.getfixturevalue(which)
    got = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in near_duplicates.groups(docs, shingle).collect()]
    assert sorted(got, key=repr) == brute_groups(docs, shingle)


def test_keys_miss_no_link():
    rng = random.Random(3)
    x = [rng.getrandbits(64) for _ in range(400)]
    y = [a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for a in x]
    held = []
    for side in (x, y):
        row, key, kind = near_duplicates.keys(np.array(side, np.uint64))
        found = [{} for _ in side]
        for r, k, s in zip(row.tolist(), key.tolist(), kind.tolist(), strict=True):
            found[r][k] = s
        held.append(found)
    assert all(any(a.get(k, 0) | s == 3 for k, s in b.items() if k in a) for a, b in zip(*held, strict=True))


def test_golay_code():
    rng = np.random.default_rng(2)
    code = near_duplicates.nearest_code(rng.integers(0, 1 << 23, 1000))
    assert code.min() >= 0 and code.max() < 4096
    words_ = np.arange(1 << 12) << 11
    assert len(np.unique(near_duplicates.nearest_code(words_ ^ near_duplicates.ERROR_OF[near_duplicates.SYNDROME_LOW[words_ & 4095] ^ near_duplicates.SYNDROME_HIGH[words_ >> 12]]))) <= 4096
    clean = words_ ^ near_duplicates.ERROR_OF[near_duplicates.SYNDROME_LOW[words_ & 4095] ^ near_duplicates.SYNDROME_HIGH[words_ >> 12]]
    assert np.array_equal(near_duplicates.nearest_code(clean), near_duplicates.nearest_code(clean ^ 0b1001000000000000001))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


def test_one_of_each_group_stays(odd):
    kept = [r["doc_id"] for r in near_duplicates.drop_near_duplicates(odd).collect()]
    assert 1 in kept and 5 not in kept and 3 not in kept and kept.count(6) == 1 and kept.count(None) == 2


def test_copies_that_only_their_base_joins(spark):
    """Copies are unlike each other, their base has a middle id: buckets whose pivots are copies."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(404)]
    rows = [(500, " ".join(base))]
    for i in [*range(200, 500), *range(501, 801)]:
        copy = list(base)
        for at in rng.sample(range(4, 400, 6), 8):
            copy[at] = f"own{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(400)} for _, t in rows]
    like = lambda a, b: len(a & b) / len(a | b)
    assert min(like(sets[0], x) for x in sets[1:]) >= 0.8 > max(like(a, b) for a, b in zip(sets[1:-1], sets[2:], strict=True))
    docs = spark.createDataFrame([*rows, (900, "some words that no other text of this table has")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in resemblance.drop_similar(docs).select("doc_id").collect()) == [200, 900]


def test_overlap_counts_common_shingles(monkeypatch):
    monkeypatch.setattr(resemblance, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    x, y = ([np.unique(rng.integers(-40, 40, n)) for n in sizes] for sizes in ((0, 5, 60), (30, 1, 0, 90)))
    assert resemblance.overlap(x, y).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]


# --- 5 licences


def test_alignment_is_a_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))] for _ in "ab")
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:]))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(pairs) <= table[-1][-1]
    c = list("abcdefgh")
    assert len(licenses.align(c, c[:3] + ["x"] + c[3:])) == 8


def test_longest_increasing():
    rng = random.Random(6)
    for _ in range(100):
        p = list(enumerate(rng.sample(range(9), 9)))
        got = licenses.longest_increasing(p)
        best = max(m.bit_count() for m in range(512) if _rising(p, m))
        assert len(got) == best and all(x[1] < y[1] for x, y in zip(got, got[1:]))


def _rising(p, m):
    chosen = [p[k][1] for k in range(len(p)) if m >> k & 1]
    return chosen == sorted(chosen)


def test_licenses(spark, odd):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(odd).collect()}
    assert (got[12]["license"], got[12]["coverage"]) == ("MIT-line", 1.0) and got[1]["n_found"] == 0 and got[2]["n_words"] == 0
    notice = licenses.TEMPLATES[2][1].replace("free of charge", "at no charge").replace("merge, ", "")
    filler = "lorem the of license copy " * 300
    text = filler + notice + filler + "Licensed under CC BY-NC 4.0."
    found = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["found"]
    assert [x["license"] for x in found] == ["MIT", "CC-BY-NC-4.0-line"] and 0.9 < found[0]["coverage"] < 1


def test_notices_at_the_least_coverage_and_side_by_side():
    scanner, text = licenses.Scanner(licenses.TEMPLATES), dict(licenses.TEMPLATES)
    bsd = text["BSD"].replace("modification", "changes").replace("permitted", "allowed").replace("conditions", "terms")
    for notice in (bsd, text["BSD"].replace("modification, are permitted provided", "changes, are allowed if")):
        direct = len(licenses.align(licenses.tokens(notice), licenses.tokens(text["BSD"])))
        found = [x for x in scanner.scan("Some words first. " + notice + " and some after.", 0.8) if x[0] == "BSD"]
        assert [(x[1], x[3]) for x in found] == [(3, direct)] and direct / 21 >= 0.8
    for name in ("MIT-line", "BSD", "MIT", "GPL-3.0-line"):
        n = len(licenses.tokens(text[name]))
        for k in (1, 2, 3, 40):
            found = [x for x in scanner.scan("It was " + " ".join([text[name]] * k) + " by them", 0.8) if x[0] == name]
            assert [(x[1], x[2], x[3]) for x in found] == [(2 + n * i, 2 + n * (i + 1), n) for i in range(k)]
    mixed = scanner.scan("Released under the MIT License. See the MIT license. Released under MIT License, released under the MIT terms", 0.8)
    assert [x[1:4] for x in mixed if x[0] == "MIT-line"] == [(0, 5, 5), (9, 13, 4), (13, 17, 4)]


# --- 6 quality


def measures(text):
    w = [x.decode() for x in words(text)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["sample", "odd"])
def test_quality_measures(request, which):
    docs = request.getfixturevalue(which)
    for r in quality.judge(docs.withColumn("_t", F.col("text"))).collect():
        n, chars, symbols, lines, repeats = measures(r["_t"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])


def test_exact_windows_where_hashes_meet(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACE_BITS", 62)  # two bits of hash are left
    monkeypatch.setattr(quality, "PLACES", (1 << 62) - 1)
    text = "a b c d a b c e f g h i j k f g h l"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.measures(df).first()["n_repeat_words"] == measures(text)[4]


def test_quality_keeps_columns(sample):
    docs = sample.withColumns({"n_words": F.lit("kept as it is"), "kept": F.lit(3)})
    got = quality.keep(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.select("n_words", "kept").distinct().collect()} == {("kept as it is", 3)}


# --- 7 substrings


def brute_removal(docs):
    seen, out = {}, []
    texts = sorted(((-1 if r["doc_id"] is None else r["doc_id"], words(r["text"])) for r in docs.collect()), key=lambda x: x[0])
    for d, w in texts:
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            seen[g] = min(seen.get(g, (d, k)), (d, k))
    for d, w in texts:
        gone = {x for k in range(len(w) - 19) if seen[tuple(w[k : k + 20])] < (d, k) for x in range(k, k + 20)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((None if d < 0 else d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["sample", "odd"])
def test_substrings(request, which):
    docs = request.getfixturevalue(which)
    assert sorted(map(tuple, substrings.remove_duplicates(docs).collect()), key=repr) == brute_removal(docs)


def test_substrings_on_hard_texts(spark):
    rng = random.Random(8)
    texts = [[rng.choice("abc") for _ in range(rng.choice((0, 19, 20, 21, 60, 200)))] for _ in range(30)]
    texts += [texts[k][rng.randint(0, 5) :] + texts[k + 1] for k in range(0, 20)] + [["a"] * 100]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(map(tuple, substrings.remove_duplicates(df).collect()), key=repr) == brute_removal(df)


# --- 8 personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
            good = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 12 <= len(number) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0, 9 <= len(number) <= 15)[kind]
            if good:
                found.append((m.start(), kind, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


TRICKY = ["a@b.c_d@e.f x@y.z..w", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "🎉 é a@b.co ñ 1.1.1.1", "a." * 500 + "@x.y", "+1+2 345 678 901 2", "--@a.b-.c"]


@pytest.mark.parametrize("which", ["sample", "odd", "tricky"])
def test_fixed_spans(request, spark, which):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string") if which == "tricky" else request.getfixturevalue(which)
    got = pii.find(docs.withColumn("_t", F.col("text"))).select("_t", pii.listed(F.col("fixed")).alias("s")).collect()
    assert len(got) == docs.count() and all(r["s"] == brute_spans(r["_t"]) for r in got)


def test_contexts_find_more(spark):
    card = ["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004", "4222222222222"]
    rows = [(i, f"payment was made today card number: {c} and then some more words {i}") for i, c in enumerate(card)]
    rows += [(10, "see card number: 4111111111111112, please"), (11, "the card number: unknown"), (12, "in room number 12345678 we met"), (13, "the total of 12345678 was paid")]
    found = {r["doc_id"]: r["s"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert found[10] == "card:17:33" and found[11] == found[12] == found[13] == "" and all(found[i].startswith("card:36:") for i in range(6))


def test_keys_induce_patterns_that_find_other_keys(spark):
    rng = random.Random(5)
    key = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, f'some words token = "{key(40, "0123456789abcdef")}" and others {i}') for i in range(6)]
    texts = {20: 'here TOKEN = "A1B2C3D4E5F6A7B8C9D0"!! it is', 21: "no token = here", 22: "a token = 12 of them", 23: 'count = "A1B2C3D4E5F6A7B8C9D0" instead'}
    got = {r["doc_id"]: [(k, r["text"][a:b]) for a, k, b in r["spans"]] for r in pii.find(spark.createDataFrame([*rows, *texts.items()], "doc_id long, text string")).collect()}
    assert got[20] == [(pii.SECRET, "A1B2C3D4E5F6A7B8C9D0")] and got[21] == got[22] == got[23] == []
    assert all(len(got[i]) == 1 and got[i][0][0] == pii.SECRET and len(got[i][0][1]) == 40 for i in range(6))


def brute_patterns(texts, support, accept, rounds):
    """The scores of all patterns around single words, from the words themselves."""
    seeds, loose, total = Counter(), Counter(), Counter()
    for t in texts:
        w = (t or "").lower().split()
        for i in range(len(w) - 2):
            total["before", w[i], w[i + 1]] += 1
            total["about", w[i], w[i + 2]] += 1
        for i, v in enumerate((t or "").split()):
            ctx = [("before", *w[i - 2 : i])] if i > 1 else []
            ctx += [("about", w[i - 1], w[i + 1])] if 0 < i < len(w) - 1 else []
            for c in ctx:
                if re.fullmatch("[0-9.]+", v) and v.count(".") == 3:
                    seeds[c, v] += 1
                elif sum(x.isdigit() for x in v) >= 6:
                    loose[c, v] += 1
    open_ = {c for c in {c for c, _ in seeds} if sum(c == d for d, _ in seeds) >= support}
    score, belief = {}, {}
    for _ in range(rounds):
        share = {c: min(1.0, (sum(n for (d, _), n in seeds.items() if d == c) + sum(n * belief.get(v, 0) for (d, v), n in loose.items() if d == c)) / total[c]) for c in open_}
        score = {c: s for c, s in share.items() if s >= accept}
        belief = {v: 1 - math.prod(1 - min(score.get(d, 0), 0.999) for d, u in loose if u == v and d in open_) for _, v in loose}
    return score


def test_scores_equal_those_of_a_plain_graph(spark):
    rng = random.Random(11)
    host = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    words_ = ["from", "host", "at", "to", "the", "node"]
    texts = [" ".join(rng.choice([*words_, host(), f"x{rng.randint(10**6, 10**6 + 4)}"] if k % 3 else words_) for k in range(rng.randint(1, 14))) for _ in range(400)]
    texts += [f"reached from host {host()} again" for _ in range(30)] + [f"from host x{10**6 + k % 3}" for k in range(6)]
    rows = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "id string, th long, text string")
    rules = pii.patterns(pii.graph(rows), rows, 3, 0.3, 3).collect()
    want = brute_patterns(texts, 3, 0.3, 3)
    assert sorted(round(r["score"], 9) for r in rules) == sorted(round(s, 9) for s in want.values()) and len(want) > 3 and {r["kind"] for r in rules} == {1}


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        sizes = [(k * 7) % 11 for k in range(n)]
        got = spark.createDataFrame([(sizes,)], "x array<bigint>").select(pii.running(F.col("x"))).first()[0]
        assert got == [sum(sizes[:k]) for k in range(n)]


def test_many_values_in_one_text(spark):
    numbers = " ".join(f"{i}.{i % 250}.1.9 {i * 7919}" for i in range(4000))
    got = pii.find(spark.createDataFrame([(1, numbers)], "doc_id long, text string")).select(pii.listed(F.col("fixed"))).first()[0]
    assert got == brute_spans(numbers)


def test_contexts_hold_numbers_and_numbers_hold_spaces(spark):
    card = ["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004", "4222222222222"]
    rows = [(i, f"my card number {1}: {c} and more") for i, c in enumerate(card)]
    rows += [(10 + i, f"please ring me at +49 171 55512{i:02d} or so") for i in range(9)]
    texts = {30: "my card number 1: 4111111111111112", 31: "ring me at (017) 555-7713, then", 32: "ring me at 0171 555 1234", 33: "ring me at 0171 555 1.2.3.4 now", 34: "ring me at 017155512345 12 times", 35: "see you at 0171 555 1234"}
    df = spark.createDataFrame([*rows, *texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][a:b] for a, _, b in r["spans"]] for r in pii.find(df).select("doc_id", "spans").collect() if r["doc_id"] >= 30}
    assert got == {30: ["4111111111111112"], 31: ["017) 555-7713"], 32: ["0171 555 1234"], 33: ["0171 555", "1.2.3.4"], 34: ["017155512345"], 35: []}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a.b@c.de, call +1 (017) 555-7713!"), (2, None), (3, "clean")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(pii.find(df)).orderBy("doc_id").collect()] == ["é mail <EMAIL>, call <PHONE>!", None, "clean"]


# --- 9 tokens


@pytest.mark.parametrize("which", ["sample", "odd"])
def test_tokens_equal_the_library(request, which):
    docs, model = request.getfixturevalue(which), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for r in docs.collect():
        ids = model.encode(r["text"] or "")
        want.append((r["doc_id"], ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, tokenizing.tokenize(docs, MODEL).collect()), key=repr) == sorted(want, key=repr)


def test_tokens_of_random_text():
    table, model, rng = tokenizing.piece_table(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("▁  aet hT\n\t日é\U0001f600\0..<>0x[]ﬁ²") for _ in range(rng.randint(0, 40)))
        ids = table.encode(text)
        assert ids == model.encode(text) and table.decode(ids) == model.decode(ids)


# --- 10 classifier


def test_statistics_of_a_small_text():
    text = "The cat, THE dog 42!\nthe cat, the end é"
    raw = text.encode()
    w = raw.split()
    x = dict(zip(classifier.STATISTICS, classifier.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist(), strict=True))
    size = [len(t) for t in w]
    share = {b: n / len(raw) for b, n in Counter(raw).items()}
    want = {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(len(w)), "mean_word": math.log1p(np.mean(size)), "spread_word": math.log1p(np.std(size)), "longest_word": math.log1p(max(size)),
        "upper": sum(65 <= b <= 90 for b in raw) / len(raw), "digit": 2 / len(raw), "comma": 2 / len(raw), "bang": 1 / len(raw), "non_ascii": 2 / len(raw), "line": 1 / len(raw), "pipe": 0,
        "distinct_words": len(set(w)) / len(w), "top_word": max(Counter(w).values()) / len(w), "repeat_pairs": 1 - len(set(zip(w, w[1:]))) / (len(w) - 1), "repeat_triples": 0,
        "short_words": sum(n <= 3 for n in size) / len(w), "digit_words": 1 / len(w), "upper_words": 2 / len(w), "entropy": -sum(p * math.log2(p) for p in share.values()),
    }
    assert all(abs(x[k] - v) < 1e-5 for k, v in want.items()), {k: (x[k], v) for k, v in want.items() if abs(x[k] - v) >= 1e-5}


def test_weights_solve_the_whole_normal_equations(spark):
    """The system of all rows, built at once by numpy, and pool-adjacent levels by their minimax formula."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(classifier.STATISTICS))).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "doc_id long, stats array<float>, label int").repartition(4)
    model = classifier.fit(rows)
    wide = x.astype(float)
    assert np.allclose(model.mean, wide.mean(0), atol=1e-6) and np.allclose(model.spread, wide.std(0), atol=1e-6)
    a = model.features(wide)
    left = a.T @ a + classifier.RIDGE * len(a) * np.diag([1.0] * classifier.FEATURES + [0.0]) + 1e-9 * np.eye(a.shape[1])
    assert np.allclose(left @ model.weights[-1], a.T @ y, atol=1e-6 * len(a))
    z, w = rng.random(40), rng.integers(1, 5, 40).astype(float)
    at, level = classifier.isotonic(np.arange(40.0), z, w)
    mean = lambda i, j: (z[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(sorted(set(np.round(want, 9))), sorted(set(np.round(level, 9)))) and np.all(np.diff(at) > 0)


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97 and (got.predicted == got.quality).mean() > 0.9


def test_classifier_ignores_held_out_labels(spark, sample):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wrong = labels.withColumn("quality", F.when(common.held_out(F.col("doc_id"), 5), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda x: sorted((r["doc_id"], round(r["score"], 9)) for r in classifier.classify(sample, x).collect())
    assert key(labels) == key(wrong)


def test_classifier_on_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1), (6, 0), (9, None), (None, 1), (12, 1), (12, 1)], "doc_id long, quality int")
    got = classifier.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in classifier.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    x, y = classifier.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert np.all(np.diff(y) >= 0) and np.isclose(y, [0, 0.5, 1]).any() and x[0] == 0


# --- all


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    frames = [
        mixing.Mix(empty).taken(), mixing.mixed_texts(empty), hmm.score(empty, rounds=1), media.read_media(media.encode_media(empty)), near_duplicates.groups(empty), near_duplicates.drop_near_duplicates(empty),
        licenses.scan_licenses(empty), quality.judge(empty), substrings.remove_duplicates(empty), pii.redact(pii.find(empty)), tokenizing.tokenize(empty, MODEL), classifier.classify(empty, labels),
    ]
    assert [df.count() for df in frames] == [0] * len(frames)


def test_quality_query_equals_its_sql(spark):
    from oracle import assert_same

    assert_same(queries.QUERIES["op6_quality"](spark, SF), queries.ORACLE_SQL["op6_quality"], SF)


def test_slices_cover_all_rows():
    offsets = np.cumsum([0, 5, 0, 7, 100, 1])
    parts = list(common.slices(offsets, 10))
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
