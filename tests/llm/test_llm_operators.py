"""The ten operators on small fixtures: brute force, round trips, edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeweave.llm import (annindex, chatformat, decontam, mixing, neardup, pii, quality, tokenpack,
                           toxicity, warc)
from codeweave.llm.common import shared_uri, text_buffers, work_dir

SF = "/root/testdata/sf0.001"
ODD = [(None, "no id here", "a"), (1, None, "a"), (2, "", None), (3, " \n\t ", "b"),
       (4, "word " * 30000, "b"), (5, "same text twice over here now", "a"),
       (5, "same text twice over here now", "a"), (6, "Same TEXT twice over here now", "c")]


# ---------------------------------------------------------------- op1

@pytest.mark.parametrize("n", [0, 1, 7, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2 ** 32, 2 ** 63])
def test_simple8b_round_trip(n, top):
    rng = np.random.default_rng(n)
    v = rng.integers(0, top, n).astype(np.uint64)
    v[rng.integers(0, max(n, 1), n // 2)] = 0
    words, counts = tokenpack.encode(v)
    assert (tokenpack.decode(words, counts, n) == v).all()


def test_pieces_equal_whole_text_encoding():
    enc = tokenpack.PieceEncoder(tokenpack.tokenizer_path())
    random.seed(5)
    texts = ["", " ", "a  b", "it's 3.14, x.\n\ny <|endoftext|>", "é\n ü 日本。 «a»"]
    texts += ["".join(random.choice("ab '\n\t .,é日1  «-Z") for _ in range(random.randrange(40)))
              for _ in range(3000)]
    data, offs = text_buffers(pa.array(texts))
    ids, n = enc.encode(data, offs)
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert enc.tok.encode(t, add_special_tokens=False).ids == got.tolist()


def test_token_report(docs):
    tok = tokenpack.PieceEncoder(tokenpack.tokenizer_path()).tok
    got = [tuple(r) for r in tokenpack.tokens_report(docs(ODD)).orderBy("start").collect()]
    want, start = [], 0
    for i, t, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokenpack.tokens_report(docs([])).count() == 0


def _fresh_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenpack.tokenizer_path())


def test_added_tokens_keep_their_id():
    tok, enc = _fresh_tokenizer(), tokenpack.PieceEncoder(tokenpack.tokenizer_path())
    random.seed(8)
    texts = ["y <|endoftext|> z", "<|endoftext|>", "a  <|endoftext|>  b", "a\n <|endoftext|>\n\nb"]
    texts += ["".join(random.choice([*"ab' \n\t.,é\u00a0", "  ", "<|endoftext|>", "<|endof"])
                      for _ in range(random.randrange(30))) for _ in range(3000)]
    data, offs = text_buffers(pa.array(texts))
    ids, n = enc.encode(data, offs)
    assert ids[:4].tolist() == [88, 220, 50256, 1976]
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert tok.encode(t, add_special_tokens=False).ids == got.tolist()


def test_report_of_a_text_with_an_added_token(docs):
    tok, text = _fresh_tokenizer(), "y <|endoftext|> z"
    ids = tok.encode(text, add_special_tokens=False).ids + [0]
    got = tokenpack.tokens_report(docs([(1, text, "a"), (2, "after", "a")])).orderBy("start").collect()
    assert tuple(got[0]) == (1, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert got[1].start == len(ids)


# ---------------------------------------------------------------- op2

def _brute(rows, percent=85):
    import re
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(
            {c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(
                    sets[i] | sets[j]):
                par[find(i)] = find(j)
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k)
               and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None) if sets[k] else (i, 0, i))
    return sorted(out, key=str)


def test_near_duplicates_against_brute_force(docs):
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    rows = list(ODD)
    for g in range(25):
        base = [random.choice(words) for _ in range(random.randrange(8, 160))]
        for _ in range(random.randrange(1, 9)):
            t = list(base)
            for _ in range(random.randrange(0, 4)):
                t[random.randrange(len(t))] = random.choice(words)
            rows.append((100 + len(rows), " ".join(t), "a"))
    got = neardup.near_duplicates(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.n_shingles)


@pytest.mark.parametrize("percent", [85, 80])
def test_links_between_components_of_one_bucket(docs, percent):
    """Groups whose members lie on both sides of the threshold: the stars
    leave several components a bucket, and the exact join must link them."""
    random.seed(percent)
    rows = [(None, "a b c d e f g h", "x"), (None, "other text without any id", "x")] * 3
    for g in range(6):
        base = [f"g{g}w{j}" for j in range(120)]
        for v in range(28):
            t = list(base)
            for at in random.sample(range(5, 115), random.randrange(1, 4)):
                t[at] = f"g{g}e{at}x{random.randrange(3)}"
            rows.append((1000 * g + v, " ".join(t), "x"))
    rows += [(7000 + i, rows[30][1], "x") for i in range(40)]
    got = neardup.near_duplicates(docs(rows), percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _brute(
        rows, percent)


def test_prefix_pairs_hold_every_similar_pair(spark):
    random.seed(9)
    sets = []
    for g in range(12):
        core = random.sample(range(g * 1000, g * 1000 + 60), 40)
        for _ in range(7):
            own = set(random.sample(core, random.randrange(33, 41)))
            own |= set(random.sample(range(50_000, 50_040), random.randrange(0, 6)))
            sets.append(sorted(own))
    nodes = [(i, s, len(s), i if i % 3 else i - 1, i % 4 != 0) for i, s in enumerate(sets) if i]
    base = work_dir(spark, "prefix-test")
    open_nodes = spark.createDataFrame([(i, n, c, p) for i, _, n, c, p in nodes],
                                       "node long, n long, comp long, probe boolean")
    frame = spark.createDataFrame([(i, s) for i, s, *_ in nodes], "node long, shingles array<long>")
    got = neardup._prefix_pairs(open_nodes, frame, 80, base).collect()
    pairs = [(r.a, r.b) for r in got]
    want = {(i, j) for i, s, _, c, p in nodes for j, t, _, d, q in nodes if i < j and c != d
            and (p or q) and 100 * len(set(s) & set(t)) >= 80 * len(set(s) | set(t))}
    assert len(want) > 20 and want <= set(pairs) and len(pairs) == len(set(pairs))


def test_hot_keys_join_like_others(spark):
    rows = spark.range(3000).selectExpr("if(id < 1000, 0, id) as k", "id as v")
    table = rows.groupBy("k").count()
    neardup_rows = neardup._join_hot(rows, table, ["k"], "count")
    assert neardup_rows.count() == 3000
    assert neardup_rows.filter("k = 0 and count = 1000").count() == 1000
    assert neardup._join_hot(rows.limit(0), table.limit(0), ["k"], "count").count() == 0


def test_one_of_each_keeps_one_of_repeated_rows(docs):
    out = [(r.doc_id, r.text) for r in neardup.one_of_each(docs(ODD)).collect()]
    assert len(out) == 6 and sum(i == 5 for i, _ in out) == 1 and not any(i == 6 for i, _ in out)
    assert neardup.one_of_each(docs([])).count() == 0


# ---------------------------------------------------------------- op3

def test_warc_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "u1", big), (2, None, big), (9, "u9", big), (9, "u9", big), (3, "u3", "é" * 600),
            (4, "u4", None), (None, "u", "short"), (5, "u\r\n5", "short")]
    pages = spark.createDataFrame([(*r, 1) for r in rows],
                                  "page_id long, url string, html string, digest int")
    folder = shared_uri(work_dir(spark, "warc-test"))
    man = warc.write_warc(pages, folder, shard_bytes=2000, roll_bytes=200)
    got = sorted((tuple(r) for r in warc.read_warc(man, folder).collect()), key=str)
    sha = {t: hashlib.sha1((t or "").encode()).hexdigest() for _, _, t in rows}
    want = []
    for k, (i, _, t) in enumerate(rows):
        rev = t == big and k != 2
        want.append((i, len((t or "").encode()), sha[t], "revisit" if rev else "response",
                     9 if rev else None))
    assert got == sorted(want, key=str)
    again = shared_uri(work_dir(spark, "warc-test"))
    two = warc.write_warc(pages.orderBy("url"), again, shard_bytes=2000, roll_bytes=200)
    names = ["file", "n_bytes", "sha1"]
    assert sorted(map(tuple, man.select(names).collect())) == sorted(
        map(tuple, two.select(names).collect()))
    empty = shared_uri(work_dir(spark, "warc-test"))
    assert warc.read_warc(warc.write_warc(pages.limit(0), empty), empty).count() == 0


# ---------------------------------------------------------------- op4

def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[500:900] = x[500]                                  # a large group of equal vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5020, [0.0] * 24, 0), (5040, [float("nan")] * 24, 0),
             (5060, [None] * 24, 0), (0, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = annindex.nearest(df, lambda c: c % 20 == 0, shard_rows=700).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        ids = [i for i in np.lexsort((np.arange(3000), -np.round(s, 9))) if i != q][:20]
        rows_q = sorted(by[q])
        assert [r for r, _, _ in rows_q] == list(range(1, 21))
        assert all(abs(s[i] - v) < 1e-9 for _, i, v in rows_q)
        hit, total = hit + len({i for _, i, _ in rows_q} & set(ids)), total + 20
    assert hit / total >= 0.9
    assert set(by) == set(range(0, 3000, 20))
    assert annindex.nearest(df.limit(0), lambda c: c % 20 == 0).count() == 0


# ---------------------------------------------------------------- op5

def test_mix_targets_and_copies(docs):
    rows = [(i, "w " * (i % 50 + 1), s) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 40)]
    out = mixing.mixed(docs(rows + ODD)).collect()
    per = {}
    for r in out:
        per.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
        assert r.taken <= 2 * r.size
    assert all(t <= 2 * s for s, t, _ in per.values())
    assert abs(sum(t for _, t, _ in per.values()) - 1.5 * sum(s for s, _, _ in per.values())) < 1e-6
    s, t, taken = per["a"]
    assert abs(taken - t) < 0.1 * t
    emitted = mixing.emitted(docs(rows))
    assert emitted.columns == ["doc_id", "text", "lang", "source", "size"]
    assert emitted.count() == sum(r.copies for r in mixing.mixed(docs(rows)).collect())
    assert mixing.mixed(docs([])).count() == 0


# ---------------------------------------------------------------- op6

def test_lcs_against_dynamic_programme():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 20)), rng.integers(0, 6, rng.integers(0, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam.lcs_length(a, b) == t[-1, -1]


def test_decontamination_finds_exact_and_edited_items(spark, docs):
    random.seed(6)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in "aeiou"] * 3 + [f"rare{i}" for i in range(900)]
    items = [(i, " ".join(random.choices(words, k=random.randrange(15, 60)))) for i in range(40)]
    bench = spark.createDataFrame(items + [(90, None), (91, "too short")], "item_id long, text string")
    rows = [(i, " ".join(random.choices(words, k=200)), "a") for i in range(300)]
    want = set()
    for i in range(0, 40):
        w = items[i][1].split()
        if i % 2:
            w[len(w) // 2] = "edited"
        pre = random.choices(words, k=random.randrange(0, 90))
        rows.append((1000 + i, " ".join(pre + w + random.choices(words, k=60)), "a"))
        want.add((1000 + i, i))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(rows + ODD), bench).collect()}
    assert got == want
    assert decontam.clean(docs(rows), bench).count() == 300
    assert decontam.contaminated(docs([]), bench).count() == 0
    assert decontam.contaminated(docs(rows), bench.limit(0)).count() == 0


def test_clean_drops_the_row_that_holds_the_item_only(spark, docs):
    item = "what is the boiling point of pure water at sea level in degrees celsius one hundred"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    leak, fine = f"so we read {item} in class", "a text about something else that nobody asked for"
    rows = [(None, leak, "a"), (5, leak, "a"), (5, fine, "a"), (None, fine, "b"), (6, None, "b")]
    got = {(r.doc_id, r.text) for r in decontam.clean(docs(rows), bench).collect()}
    assert got == {(5, fine), (None, fine), (6, None)}


def test_decontamination_recall_on_paraphrases(spark):
    """Items planted in four ways between whole documents of the test tables."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text.split()) for r in bench.orderBy("item_id").limit(40).collect()]
    carriers = [r.text for r in d.filter("length(text) between 300 and 3000").orderBy(
        "doc_id").limit(40).collect()]
    random.seed(16)

    def fifth(w):
        return [f"other{j}" if j % 5 == 2 else x for j, x in enumerate(w)]

    def third(w):
        keep = len(w) - decontam.ANSWER_WORDS
        return [f"other{j}" if j % 3 == 1 and j < keep else x for j, x in enumerate(w)]

    def longer(w):
        return [y for j, x in enumerate(w) for y in ([x, f"more{j}"] if j % 5 < 2 else [x])]

    def swapped(w):
        return w[len(w) // 2:] + w[:len(w) // 2]
    ways = [fifth, third, longer, swapped]
    rows = [(1_000_000 * (k + 1) + i, f"{carriers[n]} {' '.join(way(w))} {carriers[n - 1]}")
            for k, way in enumerate(ways) for n, (i, w) in enumerate(items)]
    plain = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, bench).collect()}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(
        d.unionByName(spark.createDataFrame(rows, d.schema)), bench).collect()}
    old = {p for p in got if p[0] < 1_000_000}
    assert len(old ^ plain) <= len(plain) // 50          # the basis moves with the corpus
    for k in range(4):
        hits = sum((1_000_000 * (k + 1) + i, i) in got for i, _ in items)
        print("RECALL", ways[k].__name__, hits)
        assert hits >= 36, ways[k].__name__
    strays = {p for p in got if p[0] >= 1_000_000 and p[0] % 1_000_000 != p[1]}
    carried = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(
        [(i, f"{carriers[n]} {carriers[n - 1]}") for n, (i, _) in enumerate(items)],
        d.schema), bench).collect()}
    assert {(i % 1_000_000, j) for i, j in strays} <= carried


def test_decontamination_finds_items_of_any_length(spark, docs):
    random.seed(66)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in "aeiou"] * 3 + [f"rare{i}" for i in range(900)]
    sizes = (1, 5, 7, 150, 200, 300, 400, 1200)
    items = [(n, " ".join([f"own{n}", *random.choices(words, k=n - 1)])) for n in sizes]
    bench = spark.createDataFrame([*items, (90, " ")], "item_id long, text string")
    rows = [(i, " ".join(random.choices(words, k=400)), "a") for i in range(150)]
    want = set()
    for n, text in items:
        for k, lead in enumerate((0, 37, 8100)):     # the last lies across two chunks
            w = text.split()
            if k == 1 and n >= 8:
                w[5::9] = ["edited"] * len(w[5::9])
            t = random.choices(words, k=lead) + w + random.choices(words, k=60)
            rows.append((10_000 + 10 * n + k, " ".join(t), "a"))
            want.add((10_000 + 10 * n + k, n))
        if 1 < n < 8:
            w = text.split()
            rows.append((10_000 + 10 * n + 9, " ".join([*w[:-1], "x", w[-1]]), "a"))
    found = decontam.contaminated(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.lcs == r.item_words for r in found if r.doc_id % 10 != 1 or r.item_id < 8)


# ---------------------------------------------------------------- op7, op9

def test_quality_agrees_with_held_labels(spark):
    d = "/root/testdata/sf0.01"
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in quality.query(spark, d).collect()}
    right = [got[i] == bool(q) for i, q in lab.items()]
    assert np.mean(right) > 0.95
    assert np.mean([got[i] for i, q in lab.items() if q]) > 0.97


def test_quality_edge_cases(docs):
    assert quality.quality(docs([])).count() == 0
    assert quality.quality(docs(ODD)).count() == len(ODD)


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in toxicity.query(spark, d).collect() if r.held_out and r.doc_id in lab]
    toxic = [r.predicted for r in rows if lab[r.doc_id]]
    clean = [r.predicted for r in rows if not lab[r.doc_id]]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_grammar_weighs_clauses_not_words():
    m = toxicity.Model({})
    table = toxicity.HashSet(m.hashes)

    def score(text):
        f = np.zeros((1, len(toxicity.CLASSES)))
        for _, h, clause, *_ in toxicity._scanned(pa.array([text])):
            f[0] = m.features(table, h, clause)
        return float(m.score(f)[0])
    plain = score("what an idiot today")
    assert score("you are an idiot") > plain
    assert score("he is not an idiot") < score("he is an idiot")
    assert score("they said idiot") < plain
    assert score("no rain, idiot") == plain              # a clause ends negation
    assert score("") == score("fine weather") < plain


def test_toxicity_edge_cases(spark, docs):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    m = toxicity.train(docs(ODD), labels)
    assert toxicity.scores(docs(ODD), m).count() == len(ODD)


# ---------------------------------------------------------------- op8

def test_surrogates(docs):
    a = "Mail ann.b@corp.com or ANN.B@CORP.COM, call +1 (212) 555-0101 or +1 212 555 0101."
    b = "ann.b@corp.com 10.20.30.40 4111111111111111 Mrs Anna Bell met Г-н Иван Козлов. Mr. Bell"
    rows = [(1, a, "x"), (2, b, "x"), (3, "clean 12 text", "x"), (4, None, "x"), (5, b, "x")]
    out, table = pii.surrogates(docs(rows))
    got = {r.doc_id: r for r in out.collect()}
    assert got[3].text == "clean 12 text" and got[3].n_entities == 0 and got[4].text is None
    assert got[2].text == got[5].text
    for secret in ("ann.b", "ANN.B", "555-0101", "10.20.30.40", "4111111111111111", "Anna Bell"):
        assert not any(r.text and secret in r.text for r in got.values())
    mail = got[2].text.split()[0]
    assert mail in got[1].text and mail.upper() in got[1].text
    digits = "".join(c for c in got[2].text.split()[2] if c.isdigit())
    luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10))
               for k, c in enumerate(reversed(digits)))
    assert len(digits) == 16 and digits[0] == "4" and luhn % 10 == 0
    import re
    assert re.search(r"Mrs [A-Z][a-z]+ [A-Z][a-z]+ met Г-н [А-Я][а-я]+ [А-Я][а-я]+\. Mr\. [A-Z]",
                     got[2].text)
    phones = re.findall(r"\+1[ (\d)-]+", got[1].text)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    t = table.collect()
    assert len({(r.kind, r.s) for r in t}) == len(t)
    assert not {r.s for r in t} & {r.canon for r in t}
    assert pii.surrogates(docs([]))[0].count() == 0


def test_surrogates_stay_distinct_in_a_crowded_format(docs):
    rows = [(i, f"a{i % 10}@m.com b{i}@n.org", "x") for i in range(300)]
    _, table = pii.surrogates(docs(rows))
    t = table.collect()
    assert len(t) == 310 and len({r.s for r in t}) == 310


def test_written_surrogates_are_distinct_and_same_in_every_spelling(docs):
    import re
    phones = [f"+1 {20 + i // 100 % 70} {10 + i // 7 % 90} {i * 37 % 100:02}" for i in range(4000)]
    phones = sorted(set(phones))
    names = [f"{t} {a}{b}" for t in ("Mr", "Dr", "Mrs") for a in "BCDFG" for b in ("ale", "orn", "ix")]
    texts = [f"call {p} now" for p in phones] + [f"met {n} today" for n in names]
    spell = ["+1 (202) 555-0100", "+12025550100", "+1-202-555-0100", "+380 44 555 0100", "+380445550100"]
    texts += [f"call {p} now" for p in spell] + ["key sk-abcdefghijklmnopqrst end"]
    out, _ = pii.surrogates(docs([(i, t, "x") for i, t in enumerate(texts)]))
    got = [r.text for r in sorted(out.collect(), key=lambda r: r.doc_id)]
    digits = [re.sub(r"\D", "", t) for t in got]
    n, m = len(phones), len(names)
    assert len(set(digits[:n])) == n and all(d[0] == "1" for d in digits[:n])
    assert not set(digits[:n]) & {re.sub(r"\D", "", p) for p in phones}
    words = [t.split()[2] for t in got[n:n + m]]
    assert len(set(words)) == m and not set(words) & {x.split()[1] for x in names}
    a, b = digits[n + m:n + m + 3], digits[n + m + 3:n + m + 5]
    assert len(set(a)) == len(set(b)) == 1 and a[0] != "12025550100"
    assert a[0][0] == "1" and b[0][:3] == "380"
    assert "abcdefghijklmnopqrst" not in got[-1] and got[-1].startswith("key sk-")


# --------------------------------------------------------------- op10

def test_snapshots_collapse(spark):
    turns = []
    for conv, n in ((1, 2), (2, 4), (3, 4), (4, 1)):
        turns += [(conv, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(n)]
    turns += [(5, 0, "user", "other <|end|>"), (5, 0, "user", "other <|end|>"), (6, 0, None, None)]
    df = spark.createDataFrame([(*t, 1) for t in turns],
                               "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chatformat.chat_documents(df).collect()}
    assert set(got) == {2, 5, 6}
    assert got[2].n_turns == 4 and got[2].n_copies == 2 and got[5].n_turns == 1
    assert got[5].rendered == "<|user|>\nother < |end| ><|end|>\n"
    assert chatformat.chat_documents(df.limit(0)).count() == 0


def test_neighbours_are_the_same_in_many_query_parts(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, annindex.nearest(
        df, lambda c: c % 2 == 0, shard_rows=500, query_bytes=b).collect()))
        for b in (1 << 20, 8 * 8 * 40))
    assert len(one) == 600 * 20 and one == many


def test_warc_shards_are_even_tasks(spark):
    n, payload = 3000, 400
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i:0{payload}}") for i in range(n)],
                                  "page_id long, url string, html string")
    folder = shared_uri(work_dir(spark, "warc-test"))
    man = warc.write_warc(pages, folder, shard_bytes=payload * 100, roll_bytes=1 << 20).collect()
    per = {}
    for r in man:
        per[r.shard] = per.get(r.shard, 0) + r.n_records
    assert len(per) == 30 and set(per.values()) == {100}
    attempts = spark.read.parquet(f"{folder}/state/attempts")
    tasks = attempts.groupBy(F.input_file_name()).agg(F.count_distinct("shard").alias("n"))
    assert {r.n for r in tasks.collect()} == {1}


def test_hot_payload_revisits_in_many_slots(spark):
    pages = spark.createDataFrame([(i, "u", ("x" if i % 3 else f"{i:04}") * 1000)
                                   for i in range(900)],
                                  "page_id long, url string, html string")
    folder = shared_uri(work_dir(spark, "warc-test"))
    got = warc.read_warc(warc.write_warc(pages, folder), folder).collect()
    assert len(got) == 900
    for r in got:
        hot = r.page_id % 3 != 0 and r.page_id != 899
        assert (r.record_type, r.refers_to) == (("revisit", 899) if hot else ("response", None))


def test_account_surrogates_keep_check_digits(docs):
    import re

    def rest(iban):
        moved = iban[4:] + iban[:4]
        return int("".join(str(int(c, 36)) for c in moved)) % 97
    good = ["DE89370400440532013000", "GB82WEST12345698765432"]
    bad = "DE00370400440532013000"
    texts = [f"pay {g} now" for g in good] + ["pay DE89 3704 0044 0532 0130 00 now", f"pay {bad} now"]
    out, table = pii.surrogates(docs([(i, t, "x") for i, t in enumerate(texts)]))
    got = [re.sub("^pay | now$", "", r.text) for r in sorted(out.collect(), key=lambda r: r.doc_id)]
    assert [g[:2] for g in got] == ["DE", "GB", "DE", "DE"] and got[2].replace(" ", "") == got[0]
    assert not set(got) & {*good, bad} and [rest(g) for g in got[:2]] == [1, 1]
    assert re.fullmatch("[0-9]{20}", got[0][2:]) and re.fullmatch("[A-Z]{4}[0-9]{14}", got[1][4:])
    assert all(rest(r.canon) == 1 and rest(r.s) == 1 for r in table.collect() if r.canon in good)
