"""Operators on documents against brute force, with odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import language, minhash, mixing, pieces, pii, toxicity
from graphloom.llm.catalog import PIECE_MODEL, SQL

from .conftest import table


def brute_components(rows, k, threshold):
    """Component of each id by comparing all pairs of shingle sets."""
    sets = defaultdict(list)
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
        s = frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])
        if i is not None and s:
            sets[i].append(s)
    parent = {i: i for i, *_ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(100 * len(a & b) >= threshold * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize(("k", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, threshold):
    got = minhash.near_duplicates(docs, k=k, threshold=threshold).collect()
    assert len(got) == len(rows)
    expected = brute_components(rows, k, threshold)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"]), r
    sizes = {r["doc_id"]: r["n_shingles"] for r in got}
    assert sizes[71] == sizes[72] == sizes[73] == 0 and sizes[74] == sizes[75] == 1


def test_every_tree_yields_candidates():
    sig = np.arange(128, dtype=np.uint16)[None, :]
    for seed in range(1, 30):
        frame = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([sig.tobytes()], pa.binary())], ["v", "sig"])
        for trees in (1, 10):
            found = [len(next(minhash._first_nodes(iter([frame]), t, 1, 5 / 3, seed))) for t in range(1, trees + 1)]
            assert found[0] > 0 and all(b > a for a, b in zip(found, found[1:], strict=False)), seed


def test_near_duplicates_of_a_hot_group(spark):
    """Hundreds of copies that part slowly, most of them not linked with each other directly."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(120)] = f"c{rng.randrange(10_000)}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, k=3, threshold=85).collect()}
    assert got == expected and len(set(expected.values())) > 20


def test_near_duplicates_ignores_other_columns_and_takes_no_rows(docs, clashing, empty):
    assert table(minhash.near_duplicates(clashing)) == table(minhash.near_duplicates(docs))
    assert minhash.near_duplicates(empty).collect() == []


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, 0, int("changed" in (t or ""))) for i, t, *_ in rows if i is not None] + [(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, clashing, empty, labels, rows):
    settings = dict(buckets=1 << 14, epochs=30)
    got = toxicity.toxicity(docs, labels, **settings)
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    by = {r["doc_id"]: r["score"] for r in found if r["doc_id"] is not None}
    assert min(by[i] for i in range(60, 70)) > max(by[i] for i in range(20, 60))
    assert by[71] == by[72]
    assert table(toxicity.toxicity(clashing, labels, **settings)) == table(got)
    assert toxicity.toxicity(empty, labels, **settings).collect() == []
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in toxicity.toxicity(docs, none, **settings).collect()} == {0.5}


def test_unseen_misspellings_share_vectors():
    texts = ["good plain words here", "what an idiot you are"] * 40
    model = toxicity.SubwordSoftmax(buckets=1 << 14, epochs=20).fit(texts, [0, 1] * 40)
    weights, bias = model.collapsed()
    score = lambda w: weights[model.features(w)].mean() + bias
    assert score("idiotic") > 0 > score("plainly")


def test_language(docs, clashing, empty, rows):
    got = language.identify_language(docs)
    found = got.collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == ("en" if i % 3 else "fr") for i in range(60) if i != 5)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (71, 72, 73))
    assert all(0 <= r["score"] <= 1 for r in found)
    assert by[1]["held_out"] == (zlib.crc32(b"1") % 3 == 1)
    assert table(language.identify_language(clashing)) == table(got)
    assert language.identify_language(empty).collect() == []
    assert {r["lang_pred"] for r in language.identify_language(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    rng = np.random.default_rng(3)
    stems = {"en": ["house", "walk", "river", "green"], "de": ["haus", "gehen", "fluss", "grün"], "fi": ["talo", "kävellä", "joki", "vihreä"]}
    langs = ["fi" if i in (0, 3000) else "de" if i % 150 == 0 else "en" for i in range(6000)]
    rows = [(i, " ".join(rng.choice(stems[x], 12)), x) for i, x in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs, max_rows=60)
    assert model.languages == ["de", "en", "fi"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(docs, max_rows=60).collect()}
    assert [got[i] for i in range(6000)] == langs


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, moves, z = language.forward_backward(emit, trans, start, np.array([4]))
    paths = {y: np.exp(start[y[0]] + sum(emit[t, 0, y[t]] for t in range(4)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product(range(3), repeat=4)}
    # the first emission belongs to the start
    total = sum(paths.values())
    assert np.isclose(z[0], np.log(total))
    for t in range(4):
        for k in range(3):
            assert np.isclose(post[t, 0, k], sum(p for y, p in paths.items() if y[t] == k) / total)
    assert np.isclose(moves.sum(), 3)


def test_numbers_are_no_letters():
    assert language._WORD.findall("² ½ ① 12 _ x² Ⅷ 一 été") == ["x", "一", "été"]


def test_words_are_found_without_the_long_class():
    import time

    odd = "² ½ ① 12 _ x² Ⅷ 一 été a½b " + "".join(map(chr, range(0x3000)))
    assert language.words_in(odd) == language._WORD.findall(odd) and language.words_in("1 ²") == language.words_in("") == []
    text = "words of letters only, and a few numbers 1 2 3; " * 5_000

    def seconds(find):
        began = time.process_time()
        find(text)
        return time.process_time() - began

    assert min(seconds(language.words_in) for _ in range(5)) * 3 < min(seconds(language._WORD.findall) for _ in range(5))


def test_code_switched_words():
    en, fr = "the house and the river were green and wide", "la maison et la rivière étaient vertes et larges"
    model = language.WordField(["en", "fr"]).fit([en] * 20 + [fr] * 20, ["en"] * 20 + ["fr"] * 20, sequences=300)
    tags = [k for _, k, _ in model.tag(["the house and the river la maison et la rivière"])[0]]
    assert tags == ["en"] * 5 + ["fr"] * 5


def test_mixing(docs, clashing, empty, rows):
    got = mixing.mix(docs)
    found = got.collect()
    assert len(found) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sums = defaultdict(int)
    for _, t, _, s, _ in rows:
        sums[s] += size(t)
    order = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets, capped, total = {}, set(), 1.5 * sum(sums.values())
    while True:
        left = total - sum(2 * sums[s] for s in capped)
        level = left / sum(weights[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weights[s] > 2 * sums[s]}
        targets = {s: 2 * sums[s] if s in capped else level * weights[s] for s in order}
        if not over:
            break
        capped |= over
    texts = {(i, size(t), sums[s], round(targets[s], 6)) for i, t, _, s, _ in rows}
    assert {(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in found} == texts
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in found)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
        largest[round(r["target"], 6), r["source_size"]] = max(largest[round(r["target"], 6), r["source_size"]], r["size"])
    for s in order:
        key = (round(targets[s], 6), sums[s])
        assert abs(taken[key] - targets[s]) <= largest[key] / 2 + 1
    assert table(mixing.mix(docs.repartition(5))) == table(got) == table(mixing.mix(clashing))
    assert mixing.mix(empty).collect() == []


def test_transfer_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    for f, s, g, t in ((0.3, 10, 0.6, 4), (0.9, 3, 0.2, 50), (0.5, 7, 0.5, 7)):
        out = [mixing.transfer(f, s, g, t, u) for u in rng.random(40_000)]
        assert all(np.isclose(a * s + b * t, f * s + g * t) and (a in (0.0, 1.0) or b in (0.0, 1.0)) for a, b in out)
        assert abs(np.mean([a for a, _ in out]) - f) < 0.01 and abs(np.mean([b for _, b in out]) - g) < 0.01


def test_mixed_documents_follow_the_mix(docs, clashing):
    plan = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        plan[r["source"]] += len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))
    assert sum(plan.values()) > 0 and mixing.mixed_documents(clashing).columns == clashing.columns


def test_personal_data(spark, docs, clashing, empty):
    import duckdb

    texts = [
        "mail a.b@c.de, a@b.cc_x@d.ee and a@b.",
        "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 001.2.3.4",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111, 378282246310005 and 12345678901234567890123",
        "phone +1 (017) 555-7713 or +12 or +44 20 7946 0958 3.",
        "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765433, ssn 078-05-1120 but 078-05-1121",
        "é𝔘 x@y.zz " * 3,
        "a" * 200_000 + " " + "1" * 200_000 + "@" * 1000,
        "1 " * 20_000,
        None,
        "",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(frame).collect()}
    spans = lambda i: [(x[0], texts[i][int(x[1]) : int(x[2])]) for x in (s.split(":") for s in got[i]["spans"].split(",") if s)]
    assert spans(0) == [("email", "a.b@c.de"), ("email", "a@b.cc"), ("email", "_x@d.ee")]
    assert spans(1) == [("ip", "1.2.3.4"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "001.2.3.4")]
    assert spans(2) == [("card", "4111 1111 1111 1111"), ("card", "378282246310005")]
    assert spans(3) == [("phone", "+1 (017) 555-7713"), ("phone", "+44 20 7946 0958 3")]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in spans(4) and ("ssn", "078-05-1120") in spans(4) and not any("GB82" in t for _, t in spans(4))
    assert [s for k, s in spans(5)] == ["x@y.zz"] * 3
    assert got[8]["base_sha256"] == got[9]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    con = duckdb.connect()
    documents = frame.where("doc_id < 6").toPandas()  # noqa: F841
    told = con.sql(SQL["op7_pii"]).df().set_index("doc_id")
    for i in (0, 1, 2, 3, 5):
        assert told.loc[i, "spans"] == got[i]["spans"] and told.loc[i, "base_sha256"] == got[i]["base_sha256"]
    assert table(pii.personal_data(clashing)) == table(pii.personal_data(docs))
    assert pii.personal_data(empty).collect() == []


def test_ibans_whatever_stands_around_them(spark):
    de, gb, fr = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"
    cases = [
        (f"IBAN {de} Please pay", [de]),
        (f"IBAN {de} BIC COBADEFFXXX", [de]),
        (f"bank {de} IS MINE", [de]),
        (f"bank {de.replace(' ', '')} 2 times", [de.replace(" ", "")]),
        (f"{gb} {fr} Paris", [gb, fr]),
        (f"REF AB12 CDEF GHIJ KLMN {de}", [de]),
        (f"𝔘 {fr}", [fr]),
        (f"bank {de[:-1]}1 BIC COBADEFFXXX", []),
        (f"bank {gb}EUR", []),
        ("AA00 " * 10_000 + f"and {de} X", [de]),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.personal_data(frame).collect():
        text, wanted = cases[r["doc_id"]]
        found = [x.split(":") for x in r["spans"].split(",") if x]
        assert [text[int(a) : int(b)] for kind, a, b in found if kind == "iban"] == wanted, text


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "x a@b.cc y +1 (017) 555-7713"), (2, None), (3, "plain")], "doc_id long, text string")
    assert [r["text"] for r in pii.redacted(frame).orderBy("doc_id").collect()] == ["x [EMAIL] y [PHONE]", None, "plain"]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(PIECE_MODEL)


def test_pieces_round_trip(docs, clashing, empty, rows, model):
    got = pieces.sampled_round_trip(docs, model)
    found = got.collect()
    assert len(found) == len(rows) and all(r["lossless"] for r in found)
    assert table(pieces.sampled_round_trip(clashing.repartition(4), model)) == table(got)
    assert pieces.sampled_round_trip(empty, model).collect() == []
    encoded = pieces.encode_pieces(clashing, model)
    assert encoded.columns == [*[c for c in clashing.columns if c not in ("text", "ids")], "ids", "n_pieces"]
    keep = pieces.encode_pieces(docs, model, keep=["doc_id", "text"])
    assert all((r["text"] or "") == r["decoded"] for r in pieces.decode_pieces(keep, model).collect())


def test_pieces_are_sampled_by_their_probability(model):
    from collections import Counter
    from math import exp

    sampler = pieces.Sampler(model, 0.5, 1)
    for word in ("thehe", " water", "é!x"):
        edges = model.edges(word)

        def paths(end):
            if not end:
                yield (), 0.0
            for start, ids, w in edges[end]:
                for a, x in paths(start):
                    yield a + ids, x + w

        weights = {a: exp(0.5 * x) for a, x in paths(len(word))}
        total, n = sum(weights.values()), 30_000
        seen = Counter(tuple(x.tolist()) for x in sampler.sample(list(range(n)), [word] * n))
        assert set(seen) <= set(weights) and max(abs(seen[a] / n - w / total) for a, w in weights.items()) < 0.015


def test_nodes_of_a_lattice_do_not_depend_on_their_neighbours(model):
    import random

    rng = random.Random(9)
    parts = ["".join(rng.choice("the andingr") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    lattices = pieces.Lattices(model, 0.5)
    _, _, cum, *_ = lattices.build(parts, 0)
    at = 0
    for chunk in (parts[:7], parts[7:1500], parts[1500:]):
        _, _, own, *_ = lattices.build(chunk, 0)
        assert np.array_equal(own, cum[at : at + len(own)])
        at += len(own)
    assert at == len(cum)


def test_one_row_of_each_group_stays_with_its_columns(spark, docs, rows):
    frame = docs.selectExpr("*", "1 as stays", "2 as `of`", "map(1, 2) as m")
    out = minhash.without_near_duplicates(frame)
    assert out.columns == frame.columns
    kept = out.collect()
    worded = [r for r in kept if r["doc_id"] is not None and (r["text"] or "").split()]
    assert len({(r["doc_id"], r["text"]) for r in worded}) == len(worded)
    assert sum(r["doc_id"] == 5 for r in worded) == 2  # an id with two texts that are unlike
    assert sum(r["doc_id"] == 4 for r in worded) == 1  # three equal rows
    assert {71, 72, 73} <= {r["doc_id"] for r in kept}


def test_filter_and_heavy_keys(spark):
    from graphloom.llm.common import join_per_key, spare, split_by_keys
    from graphloom.scratch import Scratch

    scratch = Scratch(spark, "test")
    frame = spark.range(30_000).selectExpr("id", "id % 3 as g", "'x' as h", "'y' as piece")
    keys = spark.range(1000).selectExpr("id * 7 as k")
    clear, maybe = split_by_keys(frame, frame["id"], keys, scratch)
    assert clear.columns == maybe.columns == frame.columns and clear.count() + maybe.count() == 30_000
    assert clear.where("id % 7 = 0 and id < 7000").count() == 0 and maybe.count() < 2000
    none, all_ = split_by_keys(frame, frame["id"], keys.limit(0), scratch)
    assert (none.count(), all_.count()) == (30_000, 0)
    for n in (3, 29_000):
        rows = frame.selectExpr("id", f"id % {n} as key")
        per = rows.groupBy("key").count()
        assert join_per_key(rows, per, "key", "count", 30_000, scratch).selectExpr("sum(count)").first()[0] == sum(r["count"] ** 2 for r in per.collect())
    assert spare(["A", "_a"], "a", "b") == ["__a", "b"]


def test_a_failed_sure_pair_reopens_its_leaf():
    bags = [np.array([0, 4, 1, 2, 3, 4], np.uint16)] * 3
    i, j = np.array([0, 0, 1]), np.array([1, 2, 2])
    hidden = minhash._worthwhile(i, j, np.arange(3), bags, 80, True)
    assert len(hidden) == 2 and all(flag for *_, flag in hidden)
    assert len(minhash._worthwhile(i, j, np.arange(3), bags, 80, False)) == 3


def test_samples_of_sets_go_only_to_rows_of_plausible_pairs():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 256, (40, 128)).astype(np.uint8)
    sketch[30:35] = sketch[3]
    comp = np.where(np.arange(40) == 34, 3, np.arange(40))  # 3 and 34 are linked already
    node, block = np.repeat([7, 8], 20), np.zeros(40, np.int32)
    node[30:35] = 7
    order = np.argsort(node, kind="stable")
    names = ["node", "block", "v", "comp", "n", "minor", "sk"]
    columns = [pa.array(x[order]) for x in (node, block, np.arange(40), comp, np.full(40, 300), np.ones(40, bool))]
    rows = list(minhash._plausible_rows(iter([pa.RecordBatch.from_arrays([*columns, pa.array([sketch[i].tobytes() for i in order])], names)]), 85))
    (found,) = [t for t in rows if t.num_rows]
    assert sorted(found.column("v").to_pylist()) == [3, 30, 31, 32, 33, 34]
    bag = pa.array([np.array([0, 2, 1, 2, 3], np.uint16).tobytes()] * found.num_rows)
    found = pa.RecordBatch.from_arrays([*found.columns, bag], [*found.schema.names, "bag"])
    (pairs,) = minhash._leaf_pairs(iter([found]), 85, False)
    alike = [(a, b) for a in (3, 30, 31, 32, 33, 34) for b in (3, 30, 31, 32, 33, 34) if a > b and (a, b) != (34, 3)]
    assert sorted(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)) == alike


def test_the_store_of_lattices_is_built_in_portions(model):
    import tracemalloc

    letters = np.random.default_rng(2).choice(list("etaoinshrdlu"), (5_000, 40))
    texts = ["".join(x) for x in letters]
    sampler = pieces.Sampler(model, 0.5, 1)
    tracemalloc.start()
    try:
        got = sampler.sample(list(range(5_000)), texts)
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert all(model.decode(g.tolist()) == t for g, t in zip(got, texts, strict=True))
    assert most - held < 40_000_000


def test_texts_full_of_spans(spark):
    import time

    one = "write to a.b@c.org 𝔘 or call +44 20 7946 0958 today "
    frame = spark.createDataFrame([(1, one * 20_000), (2, one)], "doc_id long, text string")
    began = time.time()
    long, short = sorted(pii.personal_data(frame).collect(), key=lambda r: -r["doc_id"])[::-1]
    assert (long["n_email"], long["n_phone"]) == (20_000, 20_000)
    expected = ",".join(f"{k}:{int(a) + i * len(one)}:{int(b) + i * len(one)}" for i in range(20_000) for k, a, b in (x.split(":") for x in short["spans"].split(",")))
    assert long["spans"] == expected
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(frame).collect()}
    assert clean[1] == clean[2] * 20_000 and clean[2] == "write to [EMAIL] 𝔘 or call [PHONE] today "
    assert time.time() - began < 60
