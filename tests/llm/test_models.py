"""Toxicity, secrets, packing and the pipeline: held-out accuracy, gradients, exact round trips, stages by hand."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tables import HARD, SF, hard_docs, rows_of

import corpus_pipeline
from threadscope.llm import packing, secrets, toxicity
from threadscope.llm.catalog import QUERIES


# --- toxicity -------------------------------------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    labels = dict(rows_of("../sf0.01/labels", "doc_id, toxic"))
    rows = [r for r in QUERIES["op5_toxicity"](spark, sf).collect()]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert not [1 for a, b in held if b and not a]


def test_toxicity_of_hard_rows(spark):
    docs = hard_docs(spark, [*HARD, *[(100 + i, ("you idiot " if i % 2 else "you friend ") * 3 + f"text {i}") for i in range(200)]])
    labels = spark.createDataFrame([(100 + i, None, i % 2) for i in range(150)] + [(1, 1, None), (None, 1, 1), (999, 1, 1), (101, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).filter("doc_id >= 250").collect()}
    assert all(r["predicted"] == d % 2 for d, r in got.items())
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema and kept.filter("doc_id between 250 and 299").count() == 25
    again = [(101, f"one of many texts of an id {i}") for i in range(150)]  # a third of all rows
    more = toxicity.fit(hard_docs(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()] + again), labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, more).filter("doc_id >= 250").collect()}
    assert all(r["predicted"] == d % 2 for d, r in got.items())
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} <= {toxicity.probability(np.log(1e-6 / (1 - 1e-6)))}
    assert toxicity.score(hard_docs(spark, []), model).count() == 0


def test_ngrams_are_those_of_the_text():
    text = "Grüße"
    points = [ord(c) for c in " grüße "]
    assert [len(g) for g in toxicity.ngrams(text)] == [len(points) - n + 1 for n in toxicity.ORDERS]
    assert set(toxicity.features("abcabc").tolist()) >= set(toxicity.features("abcabcabc")[:0].tolist())
    assert not len(toxicity.features("")) and len(toxicity.features("a")) == 1


# --- secrets --------------------------------------------------------------------------------------------------------
def rules_by_hand(text):
    key = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    found = [(m.start(), 0, m.end()) for m in re.finditer("(" + key + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s, secrets.KINDS[k], e) for s, k, e in sorted(found)]


def test_rules_on_random_texts(spark):
    rng = np.random.default_rng(6)
    bits = ["password", "PassWd", "ſecret", "secret", "TOKEN", "api_key", "apiKey", "aKey", "=", ":", " = ", '": "', "'", "é☃", "\n", "AKIA", "AKIA0123456789AB", "ABCD" * 4,
            "0123456789abcdef" * 2, "deadbeef", "x" * 200, "hunter2hunter2", "a.b/c+d-e=", " "]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 14)))) for _ in range(1500)] + [t for _, t in HARD]
    found = secrets.findings(hard_docs(spark, list(enumerate(texts)))).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["doc_id"]] or ""
        assert [(s["start"], s["kind"], s["stop"]) for s in r["rules"]] == rules_by_hand(text), text
        want = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_.=-]+", text)
                if len(m[0]) >= 16 or len(m[0]) >= 8 and (re.search("[0-9+/_=]", m[0]) or re.search("[:=][ \"']*\\Z", text[:m.start()]))]
        assert [(c["start"], c["stop"]) for c in r["cands"]] == want, text
        spans = [(s["start"], s["stop"]) for s in r["rules"]]
        for c in r["cands"]:
            parts = [(a, min(a + secrets.BODY, c["stop"])) for a in range(c["start"], c["stop"], secrets.BODY)]
            assert list(c["touched"]) == [int(any(a < y and x < b for x, y in spans)) for a, b in parts]
            assert c["label"] == max(c["touched"]) and len(c["windows"]) == secrets.WINDOW * len(parts)


def test_secrets_late_in_a_run_and_short_ones_are_learnt(spark):
    rng = np.random.default_rng(12)

    def letters(n, of="aehilnorst"):
        return "".join(rng.choice(list(of), n))

    texts = []
    for i in range(400):  # a key that starts in the third segment of its run; runs and short values without one
        texts.append(f"see {letters(150)}.{letters(48, '0123456789abcdef')} here" if i % 2 else f"see {letters(190)} here")
        texts.append(f"é login: {letters(6)}{i % 10}{letters(4, '0123456789')} now")
    found = packing.checkpoint(secrets.findings(hard_docs(spark, list(enumerate(texts)))))
    detector = secrets.fit(found, max_rows=400)
    rows = {r["doc_id"]: r["cands"] for r in found.collect()}
    assert all(len(rows[2 * i + 1]) == 1 and rows[2 * i + 1][0]["start"] == 9 for i in range(400))
    for i in range(1, 400, 2):
        assert list(rows[2 * i][0]["touched"])[0] == 0 and rows[2 * i][0]["label"] == 1
    cands = [rows[2 * i][0] for i in range(400)]
    caught = detector.probabilities([bytes(c["windows"]) for c in cands]) >= detector.threshold
    assert np.mean(caught == np.array([c["label"] for c in cands])) > 0.95
    one = ["x"] * 300 + [t for t in texts[:200]]  # most rows share a null id
    shared = secrets.findings(hard_docs(spark, [(None, t) for t in texts] + list(enumerate(one))))
    assert secrets.fit(packing.checkpoint(shared), max_rows=400) is not None
    assert secrets.fit(secrets.findings(hard_docs(spark, []))) is None


def test_network_and_threshold_come_from_all_candidates(spark):
    """Blocks far smaller than the input: every held-back candidate counts for the threshold, and all others are learnt."""
    rng = np.random.default_rng(13)
    texts = ["see " + "".join(rng.choice(list("0123456789abcdef" if i % 2 else "aehilnorst"), 40)) + " here" for i in range(2000)]
    found = packing.checkpoint(secrets.findings(hard_docs(spark, list(enumerate(texts)))))
    detector = secrets.fit(found, max_rows=100)
    every = found.selectExpr("inline(cands)", "doc_id").selectExpr("windows", "label", "pmod(xxhash64(doc_id, start), 4) = 0 as held").collect()
    p = detector.probabilities([bytes(r["windows"]) for r in every])
    label, held = np.array([r["label"] for r in every]), np.array([r["held"] for r in every])
    positive = np.sort(p[held & (label == 1)])[::-1]
    assert len(positive) > 200 and detector.threshold == positive[int(np.ceil(0.98 * len(positive))) - 1]
    assert np.mean((p >= detector.threshold) == label) > 0.97


def test_calibration_of_counts_and_of_separable_candidates():
    net = secrets.Network.new(np.random.default_rng(0))
    z, y, n = np.array([-25.0, -10, -3, 5, 9, 30]), np.array([0, 0, 0, 1, 1, 1.0]), np.array([900, 80, 20, 1, 50, 49])
    short, long = secrets.calibrate(net, z, y, n=n), secrets.calibrate(net, np.repeat(z, n), np.repeat(y, n))
    assert np.allclose([short.slope, short.offset, short.threshold], [long.slope, long.offset, long.threshold])
    p = 1 / (1 + np.exp(-(short.slope * z + short.offset)))
    assert np.allclose(short.threshold, p[4]) and p[2] < 0.5 < p[3]


def test_query_of_secrets(spark):
    texts = dict(rows_of("documents", "doc_id, text"))
    for r in QUERIES["op2_secrets"](spark, SF).collect():
        base = rules_by_hand(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, k, _ in base) for kind in secrets.KINDS[:3])
        assert {f"{k}:{s}:{e}" for s, k, e in base} <= set(r["spans"].split(",")) | {""}


def test_gradients_against_differences():
    rng = np.random.default_rng(7)
    net, x, y = secrets.Network.new(rng, 3, 4), rng.integers(0, 97, (5, secrets.WINDOW)), np.array([0, 1, 1, 0, 1.0])

    def loss():
        z = net.logits(x)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    for p, g in zip(net.parts(), net.gradients(x, y)):
        for spot in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(4)]:
            old, step = p[spot], 1e-5
            p[spot] = old + step
            up = loss()
            p[spot] = old - step
            down = loss()
            p[spot] = old
            assert abs((up - down) / (2 * step) - g[spot]) < 1e-5


def test_network_tells_keys_from_words():
    rng = np.random.default_rng(8)

    def window(key):
        return next(secrets.windows(b"some words " + key + b" and more", 11, 11 + len(key)))

    rows = [(window(bytes(rng.choice(list(b"0123456789abcdef"), 32))), 1) for _ in range(150)]
    rows += [(window(bytes(rng.choice(list(b"aehilnorst"), 24))), 0) for _ in range(150)]
    detector = secrets.train([rows[i] for i in rng.permutation(300)], rounds=40)  # few rows, so more rounds over them
    p = detector.probabilities([w for w, _ in rows])
    assert np.mean((p >= detector.threshold) == np.array([y for _, y in rows])) > 0.95
    assert secrets.train([r for r in rows if r[1]]) is None


# --- packing --------------------------------------------------------------------------------------------------------
def check_packing(rows, capacity=4096):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_are_the_tokenizers_own_and_fill_the_sequences(spark):
    from tokenizers import Tokenizer

    docs = [*HARD, *rows_of("documents", "doc_id + 1000, text")]
    rows = packing.pack_documents(hard_docs(spark, docs)).collect()
    tokenizer, want = Tokenizer.from_file(packing.default_tokenizer()), []
    for d, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    assert check_packing(rows) <= -(-sum(w[3] for w in want) // 4096) + 1
    assert packing.pack_documents(hard_docs(spark, [])).count() == 0


def test_chunks_encode_as_whole_texts():
    import random

    from tokenizers import Tokenizer

    r, model = random.Random(3), open(packing.default_tokenizer()).read()
    letters = "aAbB '’.,!?\"sS-_0129\n\t\r\x0b\x1c\x85\xa0éÉßÀçµªº½²Σσςİıſ J̌ǰ中한글가😀<|endoftext|>"
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)] + ["A <|ENDOFTEXT|> b", "x<|startoftext|>y.", "don't DON'T we'LL.", "a.,b c., d"]
    got = packing.Encoder(model).encode(odd)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in Tokenizer.from_str(model).encode_batch(odd, add_special_tokens=False)]


@pytest.mark.parametrize("sizes", [[], [4096], [1] * 50, [2049] * 7, [3000, 1096, 2000, 2096, 1500, 1500, 1096]])
def test_blocks_hold_every_piece_once(sizes):
    bins = packing.pack(sizes)
    assert sorted(r for b in bins for r in b) == list(range(len(sizes)))
    assert all(sum(sizes[r] for r in b) <= 4096 for b in bins)


def test_local_search_empties_bins():
    sizes = [6, 4, 5, 5, 3, 3, 4]  # 30 places in bins of 10
    bins = packing.improve([[0], [1, 2], [3, 4], [5, 6]], sizes, 10)
    assert len(bins) == 3 and sorted(r for b in bins for r in b) == list(range(7))
    rng = np.random.default_rng(9)
    for _ in range(20):
        sizes = rng.integers(1, 60, 80).tolist()
        first = [[i] for i in range(80)]
        better = packing.improve(first, sizes, 100)
        assert sorted(r for b in better for r in b) == list(range(80)) and all(sum(sizes[r] for r in b) <= 100 for b in better)
        assert len(better) <= 1.3 * -(-sum(sizes) // 100)
        assert len(packing.pack(sizes, 100)) <= len(packing.best_fit(sizes, 100))


def test_exchanges_see_every_piece():
    rng = np.random.default_rng(13)
    for n, top in [(3, 9), (8, 30), (90, 12), (150, 5)] * 10:
        sizes = rng.integers(1, top, 2 * n).tolist()
        give, take, space = list(range(n)), list(range(n, 2 * n)), int(rng.integers(1, 2 * top))
        gains = {sizes[d] for d in give} | {sizes[d] - sizes[t] for d in give for t in take}
        two = {sizes[d] + sizes[e] for i, d in enumerate(give) for e in give[:i]}, {sizes[t] + sizes[u] for i, t in enumerate(take) for u in take[:i]}
        gains |= {x - sizes[t] for x in two[0] for t in take} | {sizes[d] - x for x in two[1] for d in give}
        gain, out, back = packing.best_exchange(packing.Offers(give, sizes), packing.Offers(take, sizes), space)
        assert gain == max([g for g in gains if 0 < g <= space], default=0) == sum(sizes[r] for r in out) - sum(sizes[r] for r in back)
        assert set(out) <= set(give) and set(back) <= set(take) and len({*out, *back}) == len(out) + len(back)


def test_underfull_bins_of_different_blocks_meet(spark):
    # A block holds more of one length than of the other; what is left over finds its partner in other blocks only.
    sizes = [2796] * 300 + [1300] * 300
    parts = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.packed(packing.checkpoint(parts.repartition(4)), block=64).collect()
    assert len(rows) == 600 and check_packing(rows) <= 303


def test_rounds_over_many_blocks(spark):
    rng = np.random.default_rng(10)
    parts = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 4097, 600))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.packed(packing.checkpoint(parts.repartition(3)), block=100).collect()
    assert len(rows) == 600 and check_packing(rows) <= 1.06 * -(-sum(r["length"] for r in rows) // 4096) + 1


# --- pipeline -------------------------------------------------------------------------------------------------------
def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, seen, SF)
        assert after.columns == docs.columns, name
        seen = packing.checkpoint(after)
    ids = {r["doc_id"] for r in seen.collect()}
    toxic = {r["doc_id"] for r in QUERIES["op5_toxicity"](spark, SF).filter("predicted = 1").collect()}
    assert ids and not ids & toxic
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == ids
    check_packing(out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
