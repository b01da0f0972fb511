"""Decontamination, Jaccard join, fingerprints, toxicity, languages and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slatewright.llm import components, decontamination, imatch, jaccard, langid, toxicity

DOCS = "doc_id long, text string"


# --- decontamination ---------------------------------------------------------------

def norm_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items, size=10):
    windows = {}
    for i, text in items:
        words = norm_words(text)
        n = min(size, len(words))
        for p in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[p:p + n]), set()).add(i)
    out = []
    for doc_id, text in docs:
        words, hit, found = norm_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                if items_here := windows.get(tuple(words[p:p + n])):
                    hit |= set(range(p, p + n))
                    found |= items_here - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def test_contamination(spark):
    docs = [(1, "a b c d e f g h i j k É A"), (None, "A-B c"), (2, None), (3, ""), (3, ""), (4, "x É q"), (4, "..x É.."),
            (5, "é Zq"), (6, "b c d e f g h i j k l " * 300)]
    items = [(1, "x é"), (2, "a b c d e f g h i j k"), (3, ""), (4, None), (11, "X É q!"), (9, "c"), (9, "c")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], DOCS + ", pos int, _text_hash int")
    items += [(None, "a"), (None, "é zq"), (12, "é ZQ")]  # items without id hit, and are not listed
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, items string")
    got = decontamination.digest(decontamination.contamination(d, b)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_contamination(docs, items))
    clean = decontamination.clean_documents(d, b)
    assert clean.columns == d.columns
    expected = Counter(r[0] for r, x in zip(docs, brute_contamination(docs, items), strict=True) if not x[-1])
    assert Counter(r.doc_id for r in clean.collect()) == expected
    assert decontamination.contamination(d.limit(0), b).count() == 0
    assert decontamination.contamination(d, b.limit(0)).where("n_hit = 0").count() == len(docs)


# --- Jaccard join ------------------------------------------------------------------

def brute_components(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def near_copies(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(size)] for size in (4, 8, 12, 15, 18, 20, 22, 24, 26, 28, 40, 60, 90)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            p = rng.randrange(len(words))
            words[p:p + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            words = words or ["W0"]
        text = " ".join(words)
        rows.append((i, rng.choice(["", None, " ", "A b", "a B"]) if rng.random() < 0.05 else text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,boundary", [(1, None), (2, 0), (3, 19)])
def test_components_of_links(spark, monkeypatch, seed, boundary):
    """By cost, with heavy sets only, and with as many light sets as there can be."""
    if boundary is not None:
        monkeypatch.setattr(jaccard, "boundary_by_cost", lambda *_: boundary)
    rows = near_copies(seed)
    docs = spark.createDataFrame([(*r, "") for r in rows], DOCS + ", shingle string").repartition(3)
    assert sorted(map(tuple, jaccard.linked_components(docs).collect())) == brute_components(rows)


def test_hot_group_and_salting(spark, monkeypatch):
    """A third of all texts are near copies of one, in several components, over several salts."""
    monkeypatch.setattr(jaccard, "SALT_ROWS", 16)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(240):
        words = [f"n{i}x{k}" for k in range(60)]
        if i % 3 == 0:
            words = list(base)
            for p in rng.sample(range(80), rng.choice([0, 1, 1, 2, 2, 3])):
                words[p] = f"e{i}x{p}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, jaccard.linked_components(docs).collect())) == brute_components(rows)


def test_components_edges(spark):
    rows = [(1, "a b c d e"), (1, "x y z u v"), (2, "x y z u v"), (None, "a b c d e"), (0, "a b c d e")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.component_id) for r in jaccard.linked_components(docs).collect()}
    assert got == {(1, 0), (2, 0), (0, 0), (None, None)}
    assert jaccard.linked_components(docs.limit(0)).count() == 0


def test_connected(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(100)]
    rng.shuffle(chain)
    links = spark.createDataFrame([*chain, (500, 501), (501, 502), (7, 7), (500, 501)], "x long, y long")
    got = dict(map(tuple, components.connected(links).collect()))
    assert got == {**dict.fromkeys(range(101), 0), **dict.fromkeys((500, 501, 502), 500)}
    assert components.connected(links.limit(0)).count() == 0


def test_need_and_subsets():
    for a in range(1, 60):
        for b in range(1, 60):
            c = jaccard.need(a, b)
            assert 100 * c >= 85 * (a + b - c) and 100 * (c - 1) < 85 * (a + b - c + 1)
    assert jaccard.subsets(6) == 1 + 6 * 0 + (jaccard.need(6, 7) == 6)


# --- fingerprints ------------------------------------------------------------------

def test_fingerprints(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 80)))) for i in range(80)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (None, "é"), (103, "x" * 100_000), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", side int").repartition(4)
    got = imatch.edited_likeness(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    prints = {}
    by_id = {r.doc_id: r for r in got}
    for k, (known, doc_id, text) in enumerate(order):
        row = by_id[doc_id if known else None]
        after = order[(k + 1) % len(order)][2]
        q = len(text) // 4
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256((text[:len(text) - q] + after[:q]).encode()).hexdigest()
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert by_id[101].near_next == 1.0  # two empty texts
    mean = lambda name: sum(getattr(r, name) for r in got) / len(got)
    assert mean("near_edited") > 5 * mean("near_next")
    assert imatch.edited_likeness(docs.limit(0)).count() == 0
    alone = imatch.edited_likeness(spark.createDataFrame([(1, "ab cd")], DOCS)).first()
    assert alone.near_next == 1.0


def plain_prints(texts):
    """Prints of texts from their definition, with the public hash function; the lexicon comes from ``texts``."""
    import regex
    import xxhash

    def h64(raw, seed=42):
        return xxhash.xxh64_intdigest(raw, seed=seed & (1 << 64) - 1)

    def numbered(term_hash, number):
        return h64(number.to_bytes(4, "little"), h64(term_hash.to_bytes(8, "little")))

    def words(text):
        return sorted({w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", text.lower()) if w}, key=lambda w: w.encode())

    df = Counter(h64(w.encode()) for t in texts for w in words(t))
    n = len(texts)
    band = {w for w, k in df.items() if max(2.0, imatch.RARE * n) <= k <= max(2.0, imatch.COMMON * n)}

    def level(k):
        return next((i for i, most in enumerate(imatch.LEVEL_TERMS) if k <= most), len(imatch.LEVEL_TERMS))

    def of(text):
        own = [h for h in (h64(w.encode()) for w in words(text)) if h in band]
        whole = 0
        for h in own:
            whole ^= numbered(h, 7)
        if not own:
            whole = 42
            for w in words(text):
                whole = h64(w.encode(), whole)
        codes = []
        for lv, one_in in enumerate(imatch.LEVELS):
            for j in range(imatch.SUBSETS):
                held = [h for h in own if numbered(h, 32 * lv + j) % one_in == 0]
                if held and abs(lv - level(len(own))) <= 1:
                    code = 0
                    for h in held:
                        code ^= numbered(h, 7)
                    codes.append((32 * lv + j) << 16 | code & 0xFFFF)
        return len(own), whole, sorted(codes)

    def alike(a, b):
        if a[1] == b[1]:
            return 1.0
        la, lb = sorted((level(a[0]), level(b[0])))
        on = lb if lb - la <= 1 else lb - 1
        x, y = ({c for c in p[2] if c >> 21 == on} for p in (a, b))
        either = {c >> 16 for c in x | y}
        return len(x & y) / len(either) if either and lb - la <= 2 else 0.0

    def text_of(p):
        return f"{p[1]:x}:{p[0]}:" + "".join(f"{c:06x}" for c in p[2])

    return of, alike, text_of


def test_fingerprints_are_the_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_001, None), (10_002, "of the"), (10_003, "of the"), (10_004, "")], DOCS)
    docs = docs.union(odd)
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    of, alike, text_of = plain_prints(texts)
    prints = [of(t) for t in texts]
    for k, row in enumerate(sorted(imatch.edited_likeness(docs).collect(), key=lambda r: r.doc_id)):
        after = (k + 1) % len(texts)
        q = len(texts[k]) // 4
        edited = of(texts[k][:len(texts[k]) - q] + texts[after][:q])
        assert row.fingerprint == text_of(prints[k]) and row.edited_fingerprint == text_of(edited), row.doc_id
        assert abs(row.near_edited - alike(prints[k], edited)) < 1e-12 and abs(row.near_next - alike(prints[k], prints[after])) < 1e-12


# --- toxicity ----------------------------------------------------------------------

def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = {(w, False): 4.0 for w in ("idiot", "moron", "worthless", "scum", "ab")}
    trie = toxicity.Trie({**terms, ("vequ", True): 3.0})

    def distance(a, b):  # with neighbours in each other's place
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(4000):
        word = list(rng.choice([t for t, _ in terms]))
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(word) + 1)
            word[p:p + rng.randint(0, 1)] = rng.choice("idotmrnwxs") * rng.randint(0, 1)
        word = "".join(word)
        least = min(distance(word, t) if len(t) >= 5 else (0 if word == t else 9) for t, _ in terms)
        found = trie.match(word)
        assert (found is not None) == (least <= 1), word
        assert found is None or found[1] == least
    assert trie.match("vequxyz") == (3.0, 0) and trie.match("xvequ") is None and trie.match("") is None


def test_quotation_counts_apart():
    scorer = toxicity.Scorer(toxicity.ToxicityModel({("idiot", False): 5.0}))
    abuse, near, quoted, _ = scorer.features("you idiot , you 1di0t and idoit !")
    assert abuse > 0 and near > 0 and quoted == 0
    assert scorer.features('they said "idiot" about it')[:2] == [0.0, 0.0]
    assert scorer.features('they said "idiot" about it')[2] > 0
    assert scorer.score("you idiot") > scorer.score('they said "idiot" about it') > scorer.score("")


def labelled(spark, n=900):
    rng = random.Random(4)
    clean = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(3, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["trolling", "rubbish", "zork" + rng.choice("abcdefgh") * 3])
        docs.append((i, " ".join(words), "s", 1))
        labels.append((i, 1, int(bad)))
    return (spark.createDataFrame(docs, DOCS + ", source string, features int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "toxicity"]
    rows = scored.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum((r.toxicity >= toxicity.THRESHOLD) == bool(r.toxic) for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None, None, 1), (None, "", "s", 1), (2, "rubbish " * 50_000, "s", 1)], docs.schema)
    scores = {r.doc_id: r.toxicity for r in toxicity.score(odd, model).collect()}
    assert scores[1] == scores[None] < 0.5 <= scores[2]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_misspelled_inflections(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choice("bcfghk") + rng.choice("aou") for _ in range(3)) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(12)]
        if i % 3 == 0:
            words[rng.randrange(12)] = rng.choice(["idiot", "idiots", "idiotic"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    model = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(stem and "idiot".startswith(t) for t, stem in model.terms)
    trie = toxicity.Trie(model.terms)
    for word in ("idoit", "iddiot", "idoits", "diotic"):
        assert trie.match(word) is not None and trie.match(word)[1] == 1, word
        assert toxicity.Scorer(model).score(word) > toxicity.Scorer(model).score(""), word
    assert trie.match("idiotical")[1] == 0 and trie.match("idol") is None


def test_bound_of_edits_grows_with_length():
    trie = toxicity.Trie({("disgusting", False): 4.0, ("worthle", True): 3.0, ("moron", False): 2.0})
    assert trie.match("disgsutnig") == (4.0, 2) and trie.match("dsgustin") == (4.0, 2) and trie.match("xdisxgusting") == (4.0, 2)
    assert trie.match("dsgsutnig") is None and trie.match("mroonn") is None
    assert trie.match("worhtlessly") == (3.0, 1) and trie.match("xworthlessly") == (3.0, 1) and trie.match("worhtelss") is None


def test_no_labels(spark):
    docs, labels = labelled(spark, 20)
    model = toxicity.fit(docs, labels.limit(0))
    assert not model.terms
    assert toxicity.score(docs, model).where("toxicity >= 0.7").count() == 0


# --- languages ---------------------------------------------------------------------

def pages_of(spark):
    texts = {"en": "the house and the garden with this that", "fr": "la maison et le jardin avec une des", "de": "das haus und der garten mit eine ein"}
    docs = [(i, texts[lang] + f" {i}", lang) for i, lang in enumerate(["en", "fr", "de"] * 20)]
    pages = [(i, f"http://h{lang}.example.org/x", f"<html lang=en><p>{texts[lang]}</p>") for i, lang in enumerate(["fr"] * 12 + ["de"] * 12)]
    pages += [(90, "http://hfr.example.org/y", ""), (91, "http://x.example.de/", "<p>1 2 3</p>"), (92, None, None), (92, None, None)]
    return (spark.createDataFrame(docs, DOCS + ", lang string"),
            spark.createDataFrame(pages, "page_id long, url string, html string"))


def test_evidence_is_fused(spark):
    docs, pages = pages_of(spark)
    model = langid.fit(docs.union(spark.createDataFrame([(None, None, "en"), (1, "x", None)], docs.schema)))
    got = {r.page_id: r for r in langid.identify(pages, model).collect()}
    assert langid.identify(pages, model).count() == 28
    assert all(got[i].lang == "fr" for i in range(12)) and all(got[i].lang == "de" for i in range(12, 24))
    assert got[90].lang == "fr"  # the host's other pages
    assert got[91].lang == "de"  # the address
    assert 0 < got[92].posterior <= 1
    assert langid.identify(pages.limit(0), model).count() == 0
    assert {r.lang for r in langid.identify(pages, langid.TextModel()).collect()} == {None}


def test_held_out_languages(spark):
    docs, _ = pages_of(spark)
    model = langid.fit(docs, most_rows=30)
    right = sum(model.languages[max(range(3), key=lambda k: model.log_likelihoods(r.text)[k])] == r.lang for r in docs.collect())
    assert right == 60


# --- pipeline ----------------------------------------------------------------------

def test_near_duplicates_are_rows(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(0, a), (1, a), (1, b), (2, b), (3, c), (None, c + " more"), (None, c), (None, "alone it is"), (4, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS + ", lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == list(corpus_pipeline.COLUMNS)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(
        [(0, a), (1, b), (3, c), (None, "alone it is"), (4, None), (4, ""), (None, None)])


def test_pipeline(spark, tmp_path):
    """Against the stages by brute force: planted documents go, clean ones stay."""
    docs, labels = labelled(spark, 300)
    rows = [(r.doc_id, r.text, "en", f"s{r.doc_id % 2}", len(r.text)) for r in docs.collect()]
    item = " ".join(f"item{k}" for k in range(14))
    long = " ".join(f"unique{k}" for k in range(60))
    rows += [(1000, long, "en", "s0", 1), (1001, long + " more", "en", "s1", 1), (1002, "before " + item + " after", "en", "s0", 1),
             (1003, None, None, None, None), (1004, "", "en", "s1", 0)]
    kind = DOCS + ", lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, frames = spark.createDataFrame(rows, kind), []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path)).cache()
        frames.append(kept)
    assert all(f.columns == list(corpus_pipeline.COLUMNS) for f in frames[:-1])
    ids = [{r.doc_id for r in f.collect()} for f in frames]
    clean = {r[0] for r in rows if r[0] >= 1000 or r[0] % 5}
    assert len(clean - ids[0]) <= 2 and len(ids[0] - clean) <= 4
    pairs = [(r.doc_id, r.text) for r in frames[0].collect()]
    assert ids[1] == {c for *_, c in brute_components(pairs, 5, 80)}
    assert ids[1] - ids[2] == {1002} and 1000 in ids[2] and 1001 not in ids[2]
    assert ids[3] <= ids[2] and ids[4] == ids[3]
    assert frames[4].count() == frames[3].count()
    assert {r.shard for r in frames[4].collect()} == set(range(corpus_pipeline.SHARDS))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frames[4].count()
