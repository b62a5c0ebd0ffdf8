import random

import numpy as np
import pytest

from quadrat.llm import subjects as subject_module
from quadrat.llm.leaks import KEPT, SHINGLE, STRETCH, holds, leaked_items, prefix_keys, shingle_keys
from quadrat.llm.packing import Packer, fill_report, pack_documents, pieces
from quadrat.llm.subjects import document_subjects
from quadrat.llm.text import sentences, word_hashes, words


def test_words():
    assert words("<b>Águas</b> <i>turvas</i>&nbsp;do rio-\n> mar, MULTI-\nSTOREY multi-storey — fim") == ["aguas", "turvas", "do", "riomar", "multistorey", "multistorey", "fim"]
    assert words(None) == words("  ") == words("<p></p>") == []


def test_sentences():
    assert sentences("One two: three. Four five.\n\n- six seven eight\n- nine ten eleven <p>x y z</p>") == [["one", "two", "three"], ["six", "seven", "eight"], ["nine", "ten", "eleven"], ["x", "y", "z"]]
    assert sentences(None) == sentences("") == []


def text_of(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, tokens, edits):
    out = list(tokens)
    for at in sorted(rng.sample(range(1, len(tokens) - 1), edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "changed"
        elif kind == 1:
            out.insert(at, "added")
        else:
            del out[at]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_holds_against_edit_distance(seed):
    rng = random.Random(seed)
    passage = [rng.randrange(40) for _ in range(30)]
    region = [rng.randrange(40) for _ in range(5)] + edited(rng, passage[2 : 2 + 22], rng.randrange(5)) + [rng.randrange(40) for _ in range(5)]
    region = [x if isinstance(x, int) else -1 for x in region]

    def brute():
        for s in range(len(passage)):
            for a in (a for a, w in enumerate(region) if w == passage[s]):
                row = list(range(len(region) - a))
                for k, word in enumerate(passage[s + 1 :], 2):
                    new = [row[0] + 1]
                    for d, w in enumerate(region[a + 1 :]):
                        new.append(min(row[d + 1] + 1, new[d] + 1, row[d] + (word != w)))
                        if k >= STRETCH and word == w and row[d] <= k // 10:
                            return True
                    row = new
        return False

    assert holds(np.array(passage), np.array(region)) == brute()


def test_leaks(spark):
    rng = random.Random(3)
    passages = [text_of(rng, 60) for _ in range(4)]
    noise = lambda: text_of(rng, 80)
    texts = {
        1: noise() + passages[0][10:30] + noise(),
        2: noise() + passages[0][10:29] + noise(),
        3: noise() + edited(rng, passages[1][:40], 4) + noise(),
        4: [w.upper() + "," for w in passages[2]],
        5: noise(),
        6: passages[3][:12] + noise() + passages[3][12:24],
    }
    docs = [(k, " ".join(v), "x") for k, v in texts.items()] + [(7, None, "x"), (8, "", "x"), (9, " ".join(texts[1]), "x"), (1, " ".join(texts[1]), "x")]
    items = [(k, " ".join(p), "q") for k, p in enumerate(passages)] + [(10, " ".join(passages[0]), "q"), (11, None, "q"), (12, "too short", "q")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, passage string")
    i = spark.createDataFrame(items, "item_id bigint, passage string, text string")
    got = sorted(tuple(r) for r in leaked_items(d, i).collect())
    assert got == [(1, 0), (1, 10), (3, 1), (4, 2), (9, 0), (9, 10)]
    assert leaked_items(d.limit(0), i).count() == leaked_items(d, i.limit(0)).count() == 0


def test_prefix_loses_nothing():
    """A window with the allowed edits keeps a shingle of the prefix, whatever the frequencies and repeats."""
    rng = random.Random(4)
    for _ in range(200):
        passage = np.array([rng.randrange(rng.choice([3, 6, 1000])) for _ in range(40)], np.uint64)
        keys = shingle_keys(passage)
        common = {int(k): rng.randrange(5) for k in keys}
        prefix = set(prefix_keys(keys, np.array([common[int(k)] for k in keys])).tolist())
        start = rng.randrange(20)
        places = set(range(start, start + STRETCH - SHINGLE + 1))
        for at in rng.sample(range(start, start + STRETCH), 2):
            places -= set(range(at - SHINGLE + 1, at + 1))
        assert len(places) >= KEPT and {int(keys[p]) for p in places} & prefix


def test_stretches_that_repeat_their_words(spark):
    """A stretch may hold fewer distinct shingles than it must keep."""
    rng = random.Random(9)
    item = [*"abcde" * 4, *text_of(rng, 40)]
    texts = [text_of(rng, 30) + item[:20] + text_of(rng, 30), text_of(rng, 30) + item[:19] + text_of(rng, 30), item[:5] + ["x"] + item[:20]]
    got = leaked_items(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, passage string"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 7), (2, 7)]


def test_leaks_of_many_items_without_broadcasts(spark, monkeypatch):
    """Joins by key instead of broadcasts, and a bitmap that is much too small, give the same rows."""
    from quadrat import session
    from quadrat.llm import leaks

    rng = random.Random(10)
    passages = [text_of(rng, 30) for _ in range(300)]
    docs = [(k, " ".join(text_of(rng, 50) + passages[k % 300][2:28] + (passages[7] if k % 3 == 0 else []))) for k in range(200)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id long, passage string")
    wanted = sorted({(k, k) for k in range(200)} | {(k, 7) for k in range(0, 200, 3)})
    assert sorted(tuple(r) for r in leaked_items(d, i).collect()) == wanted
    monkeypatch.setattr(session, "small", lambda df: df)
    monkeypatch.setattr(leaks, "BITS", 1 << 16)
    assert sorted(tuple(r) for r in leaked_items(d, i).collect()) == wanted


def test_word_hashes():
    rng = random.Random(11)
    texts = ["One, two; three", None, "", "<p>", "ONE two-\nthree twothree", " ".join(text_of(rng, 400_000)), "a" * 3_000_000 + " one"]
    hashes, ends = word_hashes(texts)
    parts = np.split(hashes, ends[:-1])
    assert [len(p) for p in parts] == [len(words(t)) for t in texts]
    assert parts[0][0] == parts[4][0] == parts[6][1] and parts[4][1] == parts[4][2] != parts[0][1]
    assert len(np.unique(parts[5])) == len(set(words(texts[5])))
    assert [len(x) for x in word_hashes([])] == [0, 0]


def test_pieces():
    assert list(pieces(0, 5)) == [] and list(pieces(5, 5)) == [(0, 5)] and list(pieces(11, 5)) == [(0, 5), (1, 5), (2, 1)]


def test_packer_never_overfills():
    rng = random.Random(6)
    packer = Packer("p", 100, "t")
    sizes = [rng.randrange(1, 101) for _ in range(3000)]
    rows = [row for k, s in enumerate(sizes) for row in packer.add(s, [(k, 0, s)])]
    rows += list(packer.rest())
    assert sorted(i[0] for r in rows for i in r[5]) == list(range(3000))
    assert all(sum(i[2] for i in r[5]) == r[3] <= 100 for r in rows)
    assert len(rows) <= 1.03 * sum(sizes) / 100 + 5


def test_packing(spark):
    rng = random.Random(7)
    docs = [(k, " ".join(text_of(rng, rng.randrange(1, 300))), "s") for k in range(150)] + [(500, None, "s"), (501, "", "s"), (502, "palavra " * 3000, "s"), (3, "twice", "s")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, pack string").repartition(5)
    packs = spark.createDataFrame([("a", 256), ("b", 1000), ("b", 900), ("bad", 0), (None, 5)], "pack string, capacity_tokens int")
    packed = pack_documents(d, packs)
    rows = packed.collect()
    assert {r["pack"]: r["capacity"] for r in rows} == {"a": 256, "b": 1000}
    for pack, capacity in (("a", 256), ("b", 1000)):
        own = [r for r in rows if r["pack"] == pack]
        assert len({r["doc_id"] for r in own}) == 153
        assert {r["doc_id"] for r in own if r["container_id"] is None} == {500, 501}
        used = {}
        for r in own:
            if r["container_id"]:
                used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        assert max(used.values()) <= capacity
        cut = sorted((r["piece"], r["n_tokens"]) for r in own if r["doc_id"] == 502)
        assert [n for _, n in cut[:-1]] == [capacity] * (len(cut) - 1)
        assert all(sum(1 for r in own if r["doc_id"] == k) == 1 for k in range(4, 150) if sum(r["n_tokens"] for r in own if r["doc_id"] == k) <= capacity)
    assert fill_report(packed).where("pack = 'a'").first()["fill"] > 0.9
    assert pack_documents(d.limit(0), packs).count() == 0


TERMS = {"sport": "goal match referee stadium league striker".split(), "law": "court permit statute appeal notary easement".split(), "water": "river weir aquifer basin canal gauge".split()}


def sentence(rng, subject):
    own = TERMS.get(subject) or "folder archivist outline tile list message".split()
    return f"The {rng.choice(own)} of the {rng.choice(own)} is near to the {rng.choice(own)} in {rng.choice(['may', 'june'])}."


def corpus(rng, n):
    texts, truth = [], []
    for _ in range(n):
        first, second = rng.sample(sorted(TERMS), 2)
        parts = [first] * rng.randrange(4, 9) + rng.choice([[], [second] * 4, [second]]) + ["none"] * rng.randrange(3)
        rng.shuffle(parts)
        if rng.random() < 0.1:
            parts = ["none"] * 6
        texts.append(" ".join(sentence(rng, p) for p in parts))
        truth.append({s for s in TERMS if parts.count(s) / len(parts) >= 0.2})
    return texts, truth


def test_subjects(spark, monkeypatch):
    """Held-out accuracy with a fifth of wrong labels, and the odd texts."""
    rng = random.Random(8)
    texts, truth = corpus(rng, 600)
    docs = [(k, t, rng.choice(["a", "b", None]), "x") for k, t in enumerate(texts)] + [(900, None, "a", "x"), (901, " ", "a", "x"), (902, texts[0] * 500, "a", "x"), (0, texts[0], "b", "x")]
    labels = [(k, rng.choice(sorted(truth[k])) if rng.random() > 0.2 else rng.choice(sorted(TERMS)), rng.choice(["r1", "r2"])) for k in range(200) if truth[k]]
    labels += [(5000, "sport", "r1"), (3, "unknown", "r1"), (None, "sport", "r1"), labels[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, subject string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, rater string")
    sub = spark.createDataFrame([(s, s) for s in TERMS] + [(None, None)], "subject string, covers string")
    rows = document_subjects(d, lab, sub).collect()
    assert len(rows) == len(set(map(tuple, rows)))
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(k, set()) == truth[k] for k in range(200, 600)) / 400
    assert right > 0.93
    assert 900 not in got and 901 not in got and got.get(902) == truth[0]
    assert document_subjects(d, lab.limit(0), sub).count() == document_subjects(d.limit(0), lab, sub).count() == 0
    assert subject_module.SAMPLE >= 1000


def chain_of(weights, sources):
    """A chain over two subjects, a and b, without terms."""
    width = subject_module.STRUCTURE + 3 * 2
    chain = []
    for c, (own, source, before) in enumerate(weights):
        w = np.zeros(width + c)
        w[0], w[subject_module.STRUCTURE + 4 + c] = own, source
        w[width:] = before
        chain.append(w)
    return subject_module.SubjectModel(["a", "b"], {}, np.zeros((0, 3)), np.zeros((3, 0, 3)), sources, np.array([0.5, 0.5]), chain)


def test_source_cooccurrence_and_beam_decide(monkeypatch):
    """Each part of the chain changes what is found."""
    shares, sizes = np.full((1, 2), 0.2), np.array([5])
    found = lambda model, source: model.decode(model.features(shares, sizes, [source]))[0].tolist()
    by_source = chain_of([(-0.5, 3.0, []), (-0.5, 0.0, [0.0])], {"law": np.array([0.9, 0.5])})
    assert found(by_source, "law") == [True, False] and found(by_source, None) == [False, False]
    assert found(chain_of([(1.0, 0.0, []), (-0.5, 0.0, [2.0])], {}), None) == [True, True]
    assert found(chain_of([(1.0, 0.0, []), (-0.5, 0.0, [0.0])], {}), None) == [True, False]
    torn = chain_of([(0.1, 0.0, []), (3.0, 0.0, [-3.0])], {})  # a alone is likelier, but b without a far more so
    assert found(torn, None) == [False, True]
    monkeypatch.setattr(subject_module, "BEAM", 1)
    assert found(torn, None)[0]


def test_chain_is_calibrated_on_new_documents():
    """Marginals of the first chain link on documents that the model hasn't seen, in a corpus with weak terms."""
    rng = random.Random(12)
    texts, truth = corpus(rng, 700)
    names = sorted(TERMS)
    labels = [[(rng.choice(sorted(t)), "r")] if t else [] for t in truth]
    model = subject_module.fit([sentences(t) for t in texts[:300]], labels[:300], [None] * 300, names)
    x = model.features(*model.shares([sentences(t) for t in texts[300:]]), [None] * 400)
    p = 1 / (1 + np.exp(-(x @ model.chain[0])))
    y = np.array([names[0] in t for t in truth[300:]], float)
    assert abs(p.mean() - y.mean()) < 0.05 and ((p - y) ** 2).mean() < 0.05


def test_sample_is_bounded(spark, monkeypatch):
    rng = random.Random(13)
    texts, truth = corpus(rng, 120)
    d = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    rated = spark.createDataFrame([(k,) for k in range(200)], "doc_id bigint")
    whole = subject_module._sample(d, rated).count()
    monkeypatch.setattr(subject_module, "SAMPLE", 30)
    few = {r["doc_id"] for r in subject_module._sample(d, rated).collect()}
    monkeypatch.setattr(subject_module, "SAMPLE_CHARS", sum(len(texts[k]) for k in few) // 2)
    fewer = {r["doc_id"] for r in subject_module._sample(d, rated).collect()}
    assert whole == 120 and len(few) == 30 and fewer < few and sum(len(texts[k]) for k in fewer) <= subject_module.SAMPLE_CHARS


@pytest.mark.parametrize("docs", [300, 600, 3600])
def test_rare_pure_terms_speak_in_samples_of_any_size(docs):
    rng = random.Random(docs)
    names = [f"s{k}" for k in range(10)]
    texts, labels = [], []
    for d in range(docs):
        k = d % 10
        texts.append([[f"core{k}x{rng.randrange(6)}", f"core{k}y{rng.randrange(6)}", f"any{rng.randrange(40)}"] for _ in range(4)])
        texts[-1].append(["rare", f"any{rng.randrange(40)}", f"any{rng.randrange(40)}"] if k == 0 and d < 40 else [f"any{rng.randrange(40)}" for _ in range(3)])
        labels.append([(names[k], "r")])
    model = subject_module.fit(texts, labels, [None] * docs, names)
    assert "rare" in model.words
    assert model.weights[:, model.words["rare"], 0].max() > 0.3


def test_chance_pairs_do_not_speak():
    held, spread, base = np.array([[1.0], [2.0], [2.0], [4.0], [5.0]]), np.array([1, 2, 2, 4, 10]), np.array([0.3])
    assert subject_module.speaks(held, spread, base, 0.5)[:, 0].tolist() == [False, False, False, True, False]
    assert subject_module.speaks(held, spread, np.array([0.1]), 0.5)[:, 0].tolist() == [False, True, True, True, True]


@pytest.mark.parametrize("at", [0, 4060, 4090, 8170, 33_000, 36_000, 39_960])
def test_holds_in_regions_of_any_length(at):
    rng = random.Random(at)
    passage = np.array([rng.randrange(5000) for _ in range(40)])
    region = np.full(40_000, -1)
    assert not holds(passage, region)
    stretch = [*passage[:15], -1, -1, *passage[15:25], *passage[26:]]  # three edits
    region[at : at + 40] = stretch[:40]
    assert holds(passage, region)
    region[at + 2 : at + 40 : 4] = -1
    assert not holds(passage, region)


def test_leak_behind_many_repeats_of_a_run(spark):
    rng = random.Random(5)
    item = text_of(rng, 40)
    text = [w for _ in range(1200) for w in [*item[8:13], *text_of(rng, 25)]] + item
    assert len(text) > 32_768
    got = leaked_items(spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, passage string"))
    assert [tuple(r) for r in got.collect()] == [(1, 7)]


def test_tags_of_any_length():
    link = "<a class=x href='http://a.b/?" + "q=word&" * 200 + "' hidden>"
    style = '<p style="' + "color: red; " * 100 + '" id=long data-uri = "data:;' + "A" * 50_000 + '"/>'
    assert words(f"one {link}two</a> {style} three <!-- {'not a word ' * 100}--> four") == ["one", "two", "three", "four"]
    assert sentences(f"One two three {style} four five six") == [["one", "two", "three"], ["four", "five", "six"]]
    prose = "if a <b, then " + "so it goes. " * 100
    assert len(words(prose + "> end")) == 5 + 300
    assert len(words("<a " * 20_000 + "<a x=" * 20_000 + "<a " + "x " * 100_000)) > 100_000
