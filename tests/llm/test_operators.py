"""Operators against their plain versions, round trips and held-out labels."""

from __future__ import annotations

import gzip
import math
import os
import random
import uuid
import warnings
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import chat, decontaminate, fingerprint, line_dedup, mixing, pii, simhash, substring, toxicity, warc
from ledgerlake.session import shared_dir
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return rows, sorted((r["doc_id"], r["text"]) for r in rows.collect())


def passages(seed=5, n=60):
    """Texts that share passages at shifting places, and one long run of one word."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [[rng.choice(vocabulary) for _ in range(k)] for k in (34, 35, 36, 50, 90)]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for p in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = p
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    return [*texts, "same " * 200, texts[0], texts[0], "", None, " x y " + texts[1]]


def test_substring_matches_brute_force(spark):
    rows = list(enumerate(passages()))
    got = substring.substring_dedup(spark.createDataFrame(rows, DOCS), chunk_chars=2_000)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()) == sorted(brute.substring_dedup(rows))
    for r in got.where("n_removed > 0").collect():
        assert sum(b - a for a, b in r["removed"]) == r["n_removed"]
        assert all(b - a >= 35 for a, b in r["removed"])


@pytest.mark.parametrize("window", [2, 5, 12])
def test_substring_other_windows(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))) for i in range(25)]
    got = substring.substring_dedup(spark.createDataFrame(rows, DOCS), window=window, chunk_chars=100)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()) == sorted(brute.substring_dedup(rows, window))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") * 3 for _ in range(400)]
    texts = [" ".join(base)]
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts.append(" ".join(w))
    texts += ["", None, "One two", "one TWO", "ÀB c d", "àB c d", *texts[:3]]
    rows = list(enumerate(texts, 100))
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    values = [brute.simhash(t) for _, t in rows]
    want = brute.components([i for i, _ in rows], values)
    assert len(set(want)) < len(want) - 20
    assert sorted((r["doc_id"], r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in got) == sorted(
        zip((i for i, _ in rows), values, want)
    )


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_over_random_fingerprints(spark, distance):
    rng = random.Random(distance)
    values = {rng.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1, 1 << 63}
    for v in list(values):
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), distance)
    roots = {r["node"]: r["root"] for r in simhash.connected(edges).collect()}
    got = [roots.get(v, v) for v in signed]
    want = brute.components(signed, values, distance)
    pairs = set(zip(got, want))
    assert len(pairs) == len(set(got)) == len(set(want))


def test_connected_on_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000)]
    roots = {r["node"]: r["root"] for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(201)} == {0} and {roots[1000 + i] for i in range(200)} == {1000}
    assert roots[5000] == roots[5001] == 5000


def test_line_dedup_matches_brute_force(spark):
    rows = [
        (1, "Shared line here\nown line one\nshort\n"), (2, "  SHARED line here \t\nshort\nother"),
        (3, "Shared line here\r\nown line three\nown line three"), (4, ""), (5, None), (None, "shared line here\nx"),
        (7, "own line one \nÄ shared line\nä shared line"), (8, "ä shared line"), (8, "Shared line here"),
    ]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=key) == sorted(brute.line_dedup(rows), key=key)


def test_line_dedup_threshold(spark):
    rows = [(i, "a line that repeats") for i in range(3)] + [(9, "in two documents\nonly here it is"), (10, "in two documents")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS), min_documents=3)
    assert {r["doc_id"]: r["n_dropped"] for r in got.collect()} == {0: 0, 1: 1, 2: 1, 9: 0, 10: 0}


def test_contamination_matches_brute_force(spark):
    docs, plain = documents(spark)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = [(900, "two words"), (901, None), (902, "?!"), (903, "two words"), (904, "Über 10 Wörter, das ist")]
    items = items.select("item_id", "text").unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    more = [(9000, "here are TWO--words, and two words"), (9001, "über 10 wörter das IST viel"), (9002, None), (9003, "")]
    docs = docs.unionByName(spark.createDataFrame(more, DOCS))
    got = decontaminate.find_contamination(docs, items).collect()
    want = brute.contamination([*plain, *more], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(want)
    assert sum(n > 0 for *_, n, _ in want) > 3


def test_decontaminate_removes_spans_or_documents(spark):
    docs = spark.createDataFrame([(1, "Before (Two, words) after"), (2, "clean text"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert cut == {1: "Before () after", 2: "clean text", 3: None}
    whole = decontaminate.decontaminate(docs, items, remove="documents")
    assert sorted(r["doc_id"] for r in whole.collect()) == [2, 3] and whole.columns == ["doc_id", "text"]
    with pytest.raises(ValueError, match="max_windows"):
        decontaminate.find_contamination(docs, items, max_windows=1)


def pii_texts():
    return [
        "Mail a.b+c@x-y.example.org, or @no, a@b, x@y.z.w@q.r and me@here..com",
        "server 10.0.0.1 and 256.1.1.1 or 1.2.3.4.5.6.7.8 and 001.002.003.0255",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 1 4111111111111111 2",
        "call +49 (0)30 123456-78 or +1 or +1234567 or +12 345 678 901 234 567 890 tel +1.202.555.0143x",
        "iban DE89 3704 0044 0532 0130 00 ok, DE88370400440532013000 no",
        "ü😀 a@b.co ü 😀+4930123456", "", None, "1" * 20_000, "a" * 50_000 + "@", "@" * 1000, "a@" + "b." * 5_000 + "c",
        "9" * 4000 + ".1.1.1", "+1" * 3000,
    ]


def test_pii_matches_brute_force(spark):
    docs, plain = documents(spark)
    more = list(enumerate(pii_texts(), 9000))
    found = pii.find_pii(docs.unionByName(spark.createDataFrame(more, DOCS))).collect()
    got = {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] != "iban"] for r in found}
    assert got == {i: brute.base_spans(t) for i, t in [*plain, *more]}
    texts = dict([*plain, *more])
    for r in found:
        for s in r["pii"]:
            assert texts[r["doc_id"]][s["start"] : s["end"]] == s["match"] and 0 <= s["score"] <= 1
    by_id = {r["doc_id"]: r["pii"] for r in found}
    assert [s["match"] for s in by_id[9004] if s["kind"] == "iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert [s["score"] for s in by_id[9002] if s["kind"] == "card"][0] == 1.0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "😀 mail a@b.co now"), (2, "plain"), (3, None), (4, "+4930123456")], DOCS)
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "😀 mail <email> now", 2: "plain", 3: None, 4: "<phone>"}


def test_ibans_end_where_the_account_does(spark):
    account, spaced = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    texts = {f"IBAN {a} {after}": a for a in (account, spaced, "NO9386011117947") for after in ("BIC COBADEFFXXX", "EUR 120", "2 times", "ok", "")}
    texts |= {f"{account} {spaced}": f"{account},{spaced}", f"{account}1": "", "DE88370400440532013000 EUR 1": ""}
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = {r["text"]: ",".join(s["match"] for s in r["pii"] if s["kind"] == "iban") for r in pii.find_pii(docs).collect()}
    assert found == texts
    cut = {r["doc_id"]: r["text"] for r in pii.redact(docs, kinds=("iban",)).collect()}
    assert cut[0] == "IBAN <iban> BIC COBADEFFXXX" and cut[1] == "IBAN <iban> EUR 120"


PAGES = "page_id long, url string, html string"


def pages():
    big = "ü<p>WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "0123456789é" * 30_000
    same = "x" * 100
    return [
        (5, "http://a/\r\nX: y", same), (3, "http://b", same), (9, None, same), (1, "u", "y" * 99), (2, "u", "y" * 99),
        (4, "big", big), (6, "empty", ""), (7, "null", None), (8, "big2", big), (10, "tiny", "\r\n0\r\n\r\n"), (None, "n", same),
    ]


def test_warc_round_trip(spark):
    path = shared_dir(spark, f"test-warc-{uuid.uuid4().hex}")
    warc.write_warc(spark.createDataFrame(pages(), PAGES), path, segment_bytes=1_000, records_per_file=4)
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 300
    got = {warc_id: r for r in warc.read_warc(spark, path).collect() for warc_id in [r["record_id"].split(":")[2]]}
    assert len(got) == len(pages()) and all(r["complete"] for r in got.values())
    for page_id, _, html in pages():
        r = got["" if page_id is None else str(page_id)]
        payload = (html or "").encode()
        assert r["payload_digest"] == brute.sha(html or "") and r["payload_bytes"] == len(payload)
        revisit = page_id in (5, 9, 8, None)
        assert (r["record_type"] == "revisit") is revisit
        assert r["payload"] is None if revisit else bytes(r["payload"]) == payload
        if revisit:
            target = {5: 3, 9: 3, None: 3, 8: 4}[page_id]
            assert r["refers_to"] == got[str(target)]["record_id"]


def test_warc_damage_is_reported(spark):
    def record(kind, name, block, **more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"Content-Length: {len(block)}"]
        head += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in more.items()]
        return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = http + b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    n = len(body)
    data = (
        record("warcinfo", "info", b"k: v")
        + record("continuation", "s3", body[60:], Segment_Number=3, Segment_Origin_ID="<s>", Segment_Total_Length=n)
        + record("response", "s", body[:50], Segment_Number=1)
        + record("continuation", "s2", body[50:60], Segment_Number=2, Segment_Origin_ID="<s>")
        + record("response", "gap", body[:50], Segment_Number=1)
        + record("continuation", "g3", body[60:], Segment_Number=3, Segment_Origin_ID="<gap>", Segment_Total_Length=n)
        + record("response", "alone", body[:50], Segment_Number=1)
        + record("response", "chunk", http + b"9\r\nabc\r\n0\r\n\r\n")
        + record("response", "digest", http + b"0\r\n\r\n", Payload_Digest="sha256:00")
        + record("response", "cut", body)[:-20]
    )
    path = shared_dir(spark, f"test-warc-{uuid.uuid4().hex}")
    os.makedirs(path.removeprefix("file:"))
    with gzip.open(path.removeprefix("file:") + "/part-1.warc.gz", "wb") as f:
        f.write(data)
    got = {r["record_id"]: (r["complete"], bytes(r["payload"] or b"")) for r in warc.read_warc(spark, path).collect()}
    assert got.pop("<info>") == (True, b"k: v")
    assert got.pop("<s>") == (True, b"abcde")
    assert set(got) == {"<gap>", "<alone>", "<chunk>", "<digest>", "<cut>"} and not any(ok for ok, _ in got.values())


def test_imatch(spark):
    docs, plain = documents(spark)
    got = {r["doc_id"]: r for r in fingerprint.edit_robustness(docs, bucket_chars=60_000).collect()}
    assert len(got) == len(plain)
    by_text = {}
    for i, (doc_id, text) in enumerate(plain):
        following = plain[(i + 1) % len(plain)][1]
        h = len(text) // 2
        edited = text[: len(text) - h] + following[:h]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), brute.sha(edited))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    near, far = (np.array([r[k] for r in got.values()]) for k in ("near_edited", "near_next"))
    assert (near > far).mean() > 0.85 and near.mean() > 10 * far.mean()
    again = {r["doc_id"]: r["fingerprint"] for r in fingerprint.imatch(docs).collect()}
    assert again == {i: r["fingerprint"] for i, r in got.items()}


def test_likeness_and_lexicon(spark):
    words = ["common"] * 4 + ["mid"] * 2 + ["rare"]
    docs = spark.createDataFrame([(i, " ".join({w, "every"})) for i, w in enumerate(words)], DOCS)
    hashed = lambda *ts: set(fingerprint._hashed([t.encode() for t in ts]).tolist())
    assert set(fingerprint.lexicon(docs, math.log(7 / 4) - 0.01, math.log(7 / 2) + 0.01).tolist()) == hashed("common", "mid")
    s = fingerprint.Subsets(np.empty(0, np.uint64))
    a, b, empty = s.fingerprint("one two three four"), s.fingerprint("Four, three TWO one"), s.fingerprint(None)
    assert fingerprint.likeness(a, b) == 1.0 and fingerprint.likeness(a, empty) == 0.0 and fingerprint.likeness(empty, empty) == 1.0


def test_toxicity_on_held_out_rows(spark):
    """Insults with many endings, each of them rare, in otherwise like texts."""
    rng = random.Random(11)
    parts = ["an", "er", "tion", "the", "ou", "sh", "in", "st", "ea", "nd"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(rng.randrange(10, 120))]
        toxic = int(rng.random() < 0.2)
        for _ in range(max(1, len(words) // 25) * toxic):
            words[rng.randrange(len(words))] = rng.choice(["grobix", "zlumf"]) + word()
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    frame = spark.createDataFrame(docs, DOCS).repartition(4)
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(frame, toxicity.fit(frame, truth)).withColumn("held", toxicity.held_out(F.col("doc_id")))
    rows = scored.join(truth, "doc_id").where("held").collect()
    caught = [r["predicted"] for r in rows if r["toxic"]]
    alarms = [r["predicted"] for r in rows if not r["toxic"]]
    assert len(rows) > 400 and np.mean(caught) > 0.9 and np.mean(alarms) < 0.01


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " + ("bad" if i % 2 else "good")) for i in range(80)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda ls: {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, ls)).collect()}
    assert score(labels) == pytest.approx(score(flipped), abs=1e-12)


def not_held_out(spark, n):
    ids = spark.range(n).select("id", toxicity.held_out(F.col("id")).alias("held")).orderBy("id").collect()
    return iter([r["id"] for r in ids if not r["held"]]), iter([r["id"] for r in ids if r["held"]])


def test_toxicity_of_spellings_that_are_rare_in_a_large_corpus(spark):
    """Each insult, and each name, stands in two of the training texts, its
    n-grams are under 2e-7 of those of their order."""
    rng = random.Random(3)
    learned, held = not_held_out(spark, 1500)
    common = " ".join(f"w{i:07d}" for i in range(25_000))
    insults, names = (["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(40)] for _ in range(2))
    docs, labels = [], []
    for i in range(60):
        docs.append((next(learned), f"{common} {i}"))
        labels.append((docs[-1][0], 0))
    for word, toxic in [(w, 1) for w in insults * 2] + [(w, 0) for w in names * 2]:
        docs.append((next(learned), f"w{rng.randrange(25_000):07d} {word} w{rng.randrange(25_000):07d}"))
        labels.append((docs[-1][0], toxic))
    asked = {next(held): (w, toxic) for toxic, words in ((1, insults), (0, names)) for w in words}
    docs += [(i, f"w0000100 {w} w0000200") for i, (w, _) in asked.items()]
    frame = spark.createDataFrame(docs, DOCS).repartition(4)
    scored = toxicity.score(frame, toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int")))
    got = {r["doc_id"]: r["predicted"] for r in scored.select("doc_id", "predicted").collect()}
    assert np.mean([got[i] for i, (_, toxic) in asked.items() if toxic]) > 0.8
    assert np.mean([got[i] for i, (_, toxic) in asked.items() if not toxic]) < 0.1


def test_toxicity_ratios_match_plain_counts(spark):
    """All training texts are counted, and the joins give the model's ratios."""
    docs, plain = documents(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    held = {r["doc_id"] for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    texts = {(t or "", truth[i]) for i, t in plain if i in truth and i not in held}
    five = {}
    for text, toxic in texts:
        for word in set(toxicity.alnum_words(text)):
            for g in toxicity.grams(word):
                five.setdefault(g, [0, 0])[toxic] += 1
    assert {bytes(r["item"]): [r["n0"], r["n1"]] for r in model.counts.collect()} == five

    def lower(counts):
        """Kneser-Ney counts of the next order: how many bytes precede it, or texts at a word's begin."""
        out = {}
        for g, ns in counts.items():
            for c in (0, 1):
                if ns[c]:
                    out.setdefault(g[1:], [0, 0])[c] += ns[c] if g[1:2] == b"\x01" else 1
        return out

    four = lower(five)
    want = {**five, **four, **lower(four)}
    pairs = {}
    for g in lower(four):
        pairs.setdefault(g[1:], set()).add(g[:1])
    pairs = {g: len(before) for g, before in pairs.items()}
    singles = Counter(g[1:] for g in pairs)

    def shared(pair):
        """Orders 1 and 2, of both classes."""
        own = [n for g, n in pairs.items() if g[:1] == pair[:1]]
        single = (max(singles[pair[1:]] - 0.75, 0) + 0.75 * len(singles) / 256) / sum(singles.values())
        return (max(pairs.get(pair, 0) - 0.75, 0) + 0.75 * len(own) * single) / sum(own) if own else single

    after = {}
    for g, n in want.items():
        after.setdefault(g[:-1], []).append(n)

    def ratio(gram):
        p = [shared(gram[-2:])] * 2
        for g in (gram[-3:], gram[-4:], gram):
            for c in (0, 1):
                total = sum(n[c] for n in after.get(g[:-1], []))
                if total:
                    rest = 1 - sum(max(n[c] - 0.75, 0) for n in after[g[:-1]]) / total
                    p[c] = max(want.get(g, [0, 0])[c] - 0.75, 0) / total + rest * p[c]
        return math.log(p[1] / p[0])

    asked = [*{g for w in ("qqqq", "the", "\u00e9t\u00e9", *(plain[0][1] or "").split()) for g in toxicity.grams(w.encode())}]
    frame = spark.createDataFrame([(g,) for g in asked], "g binary")
    got = {bytes(r["g"]): r["ratio"] for r in toxicity.gram_ratios(frame, model).collect()}
    assert got == {g: pytest.approx(ratio(g), abs=1e-9) for g in asked}

    by_gram = {g: ratio(g) for _, t in plain for w in set(toxicity.alnum_words(t)) for g in toxicity.grams(w)}
    bias, *weights = model.weights
    score_of = {}
    for i, text in plain:
        words = [min(max(sum(by_gram[g] for g in toxicity.grams(w)), -50), 50) for w in toxicity.alnum_words(text)]
        n = max(len(words), 1)
        f = (sum(words) / n, sum(w for w in words if w > 3) / n, math.log(n))
        score_of[i] = 1 / (1 + math.exp(-min(max(bias + sum(w * x for w, x in zip(weights, f)), -30), 30)))
    for r in toxicity.score(docs, model).select("doc_id", "score", "predicted").collect():
        assert r["score"] == pytest.approx(score_of[r["doc_id"]], abs=1e-9) and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity_learns_from_one_text_of_a_class(spark):
    learned, _ = not_held_out(spark, 30)
    texts = ["you grobix", "hello there", "good day", "fine words", "kind regards", "many thanks"]
    docs = spark.createDataFrame([(next(learned), t) for t in texts], DOCS)
    labels = docs.select("doc_id", F.col("text").contains("grobix").cast("int").alias("toxic"))
    got = {r["text"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert got["you grobix"] > max(got[t] for t in texts[1:]) > 0


def test_raking_meets_the_targets(spark):
    rng = random.Random(1)
    rows = [(a, b, c, rng.randrange(500, 5000)) for a in ("s0", "s1", "other") for b in ("x", "y") for c in ("p", "q")]
    cells = spark.createDataFrame(rows, "mix_source string, mix_lang string, mix_topic string, tokens long")
    targets = {"mix_source": {"s0": 0.3, "s1": 0.7}, "mix_lang": {"x": 0.4, "y": 0.6, "absent": 0.5}, "mix_topic": {"p": 0.5, "q": 0.5}}
    got = mixing.rake(cells.coalesce(1), targets, keep_share=0.2, sweeps=15).toPandas()
    total, other = got.tokens.sum() * 0.2, got.tokens[got.mix_source == "other"].sum() * 0.2
    assert (got.weight <= got.tokens).all() and got.weight.sum() == pytest.approx(total)
    by = lambda c: got.groupby(c).weight.sum() / total
    assert by("mix_lang")["x"] == pytest.approx(0.4) and by("mix_topic")["p"] == pytest.approx(0.5)
    assert by("mix_source")["s0"] == pytest.approx(0.3 * (1 - other / total)) and by("mix_source")["other"] == pytest.approx(other / total)


def test_mix_draws_by_probability(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("one two three").alias("text"),
        F.when(F.col("id") % 3 == 0, "src0").otherwise("rest").alias("source"), F.lit("en").alias("lang"),
    )
    mixed = mixing.mix(docs, {"src0": 0.8, "rest": 0.2}, {"en": 1.0}, {"prose": 1.0}, keep_share=0.3)
    got = mixed.groupBy("source").agg(F.avg("keep_p").alias("p"), F.avg(F.col("kept").cast("int")).alias("k")).collect()
    p = {r["source"]: r["p"] for r in got}
    assert p["src0"] == pytest.approx(0.3 * 0.8 * 3) and p["rest"] == pytest.approx(0.3 * 0.2 * 1.5)
    assert all(abs(r["k"] - r["p"]) < 0.05 for r in got)


def test_mix_meets_targets_with_a_scarce_margin(spark):
    """Contact holds 3 of 100 documents and is to be 10 of 100: half of all
    tokens can't be kept at that, three tenths can."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 100 < 3, "to a@b.org now").otherwise("one two three").alias("text"),
        F.when(F.col("id") % 7 < 2, "src0").otherwise("src1").alias("source"), F.when(F.col("id") % 11 < 3, "en").otherwise("de").alias("lang"),
    )
    targets = ({"src0": 0.6, "src1": 0.4}, {"en": 0.5, "de": 0.5}, {"prose": 0.9, "contact": 0.1})
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixed = mixing.mix(docs, *targets).cache()
    weight = F.sum(F.col("mix_tokens") * F.col("keep_p"))
    total = mixed.agg(weight).first()[0]
    for margin, shares in zip(mixing.MARGINS, targets):
        got = {r[0]: r[1] / total for r in mixed.groupBy(margin).agg(weight).collect()}
        assert got == {v: pytest.approx(x, rel=1e-3) for v, x in shares.items()}
    assert mixed.agg(F.max("keep_p")).first()[0] <= 1.0 and total > 0.2 * mixed.agg(F.sum("mix_tokens")).first()[0]
    with pytest.warns(UserWarning, match="mix_topic=contact"):
        mixing.mix(docs, *targets, keep_share=0.5)


def test_chat_perspectives(spark):
    rows = [(1, 2, "bob", "second"), (1, 1, "ann", "first <|im_end|>"), (1, 0, "system", "be kind"), (1, 130, "bob", "😀 later")]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["perspective"], r["part"], r["n_turns"]) for r in got) == [("ann", 0, 3), ("ann", 2, 1), ("bob", 0, 3), ("bob", 2, 1)]
    for r in got:
        learned = "".join(r["rendered"][m["start"] : m["end"]] for m in r["mask"])
        own = [t for _, turn, name, t in sorted(rows, key=lambda x: x[1]) if name == r["perspective"] and turn // 64 == r["part"]]
        assert learned == "".join(t.replace("<|im_", "< |im_") + "<|im_end|>" for t in own)
    ann = next(r for r in got if r["perspective"] == "ann" and r["part"] == 0)
    assert ann["rendered"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nfirst < |im_end|><|im_end|>\n"
        "<|im_start|>user name=bob\nsecond<|im_end|>\n"
    )


def test_a_scarce_topic_does_not_set_the_budget(spark):
    """One value has 1e-5 of the tokens and a tenth of the target."""
    cells = spark.createDataFrame(
        [(f"src{i}", lang, topic, n) for i, k in ((0, 3), (1, 1)) for lang, m in (("en", 2), ("de", 1))
         for topic, n in (("prose", 400_000 * k * m), ("legal", 60_000 * k * m), ("contact", 5 * k * m))],
        "mix_source string, mix_lang string, mix_topic string, tokens long",
    )
    wanted = ({"src0": 0.6, "src1": 0.4}, {"en": 0.5, "de": 0.5}, {"prose": 0.8, "legal": 0.1, "contact": 0.1})
    targets = dict(zip(mixing.MARGINS, wanted))
    fitted = mixing.rake_budget(cells, targets, 0.5).cache()
    got = fitted.toPandas()
    assert got["weight"].sum() == pytest.approx(0.5 * got["tokens"].sum(), rel=0.01) and (got["weight"] <= got["tokens"] + 1e-6).all()
    rest = {(r["margin"], r["value"]): r for r in mixing.residuals(fitted, targets).collect()}
    assert len(rest) == 7 and rest["mix_topic", "contact"]["weight"] == pytest.approx(60, rel=0.01)
    assert rest["mix_source", "src0"]["got"] == pytest.approx(0.6, rel=0.01) and rest["mix_lang", "de"]["got"] == pytest.approx(0.5, rel=0.01)
    assert rest["mix_topic", "prose"]["got"] == pytest.approx(0.8 / 0.9, rel=0.01)


def test_topic_hints_change_no_topic(spark):
    texts = ["LICENSE", "a licence", "CopyRight x", "x@y.z", "a@b", "+1", "+ 1", "!!", "%&#", "plain", "", " \t\n", "a  b\x0bc ", "l\u0130cense"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(mixing.topic_of(F.col("text")).alias("a"), mixing.topic_of(F.col("text"), hints={}).alias("b"), "text", mixing.token_count(F.col("text")).alias("n"))
    for r in got.collect():
        assert r["a"] == r["b"] and r["n"] == len((r["text"] or "").split()), r
