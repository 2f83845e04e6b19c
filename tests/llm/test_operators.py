"""The ten operators against brute force, and their defined results for odd input."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orthoflux.llm import audio, langid, pii, queries, toxicity
from orthoflux.operators.components import graph_components
from orthoflux.llm.decontam import drop_contaminated, find_overlaps
from orthoflux.llm.mixing import mix_sources
from orthoflux.llm.neardup import near_duplicates
from orthoflux.llm.substring_dedup import remove_repeated
from orthoflux.llm.token_files import EliasFano, WordEncoder, read_token_files, write_token_files
from orthoflux.llm.warc import normalize_archives, read_archives, write_archives

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, source string, id long, size long, bucket string, key string, seed long, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, copies, repeated rows, a very long text, and columns named as operators name theirs."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    base = [word() for _ in range(120)]
    near = base[:60] + ["zzz"] + base[61:]
    long = [word() for _ in range(30_000)]
    texts = [(1, " ".join(base)), (2, " ".join(base)), (3, "\t".join(near)), (4, None), (5, ""), (6, " \n\x0b "), (7, "one two"), (8, "ONE two"), (None, " ".join(base)), (9, " ".join(long)), (10, " ".join(long[:400] + base[:55])), (7, "one two"), (11, "é ü ß"), (-5, "x " * 200)]
    return spark.createDataFrame([(i, t, s, 9, 9, "b", "k", 0, "s") for (i, t), s in zip(texts, ["a", "b", None, "a", "", "b", "c", "c", "a", "b", "a", "c", "d", "d"], strict=True)], ODD)


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (3, 3), (20, 30), (30, 20)]
    got = {r.node: r.component for r in graph_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 20: 20, 30: 20}
    assert graph_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_one_task_and_by_stars(spark, tmp_path, monkeypatch):
    """Both ways agree on paths, stars and random graphs; a graph that a task can hold needs no shuffle."""
    from orthoflux.operators import components

    rnd = random.Random(8)
    path = rnd.sample(range(-300, 0), 300)
    edges = [*zip(path, path[1:]), *((5000, i) for i in range(4000, 4100)), *((rnd.randint(0, 999), rnd.randint(0, 999)) for _ in range(600)), (7, None), (None, None), (2000, 2000), (-5, -5)]
    spark.createDataFrame(edges, "a long, b long").write.parquet(f"{tmp_path}/edges")
    df = spark.read.parquet(f"{tmp_path}/edges")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    found = set(tracker.keySet().toString()[4:-1].split(", "))
    got = sorted(graph_components(df).collect())
    added = set(tracker.keySet().toString()[4:-1].split(", ")) - found
    assert len(added) <= 1  # the count's
    monkeypatch.setattr(components, "TASK_EDGES", 0)
    assert sorted(graph_components(df).collect()) == got
    comp = {r.node: r.component for r in got}
    assert all(comp[a] == comp[b] for a, b in edges if a is not None and b is not None and a != b)
    assert {comp[i] for i in path} == {-300} and {comp[i] for i in range(4000, 4100)} == {4000} and 2000 not in comp


def brute_sets(docs):
    out = []
    for i, t in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_duplicates(spark, sf_dir, odd, which):
    df = odd if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = brute_sets(rows(df))
    comp = {i: i for i, _ in sets if i is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            k = len(s & t)
            if k and 100 * k >= 75 * (len(s) + len(t) - k):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def test_near_duplicates_without_a_common_least(spark):
    """Copies of one text that is not the least id, too far from each other: all hang on the original."""
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(400)]
    docs = [(900, " ".join(base))]
    for i in range(40):
        own = list(base)
        for k in rnd.sample(range(0, 400, 8), 11):
            own[k] = f"x{i}_{k}"
        docs.append((i, " ".join(own)))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_remove_repeated(spark, sf_dir, odd, which):
    df = odd if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(i, WORD.findall(t or "")) for i, t in rows(df)]
    first = {}
    for i, w in docs:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(i, first.get(key, i))
    expect = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        expect.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    out = remove_repeated(df).collect()
    got = [(r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.removed), r.kept_text) for r in out]
    assert sorted(got, key=str) == sorted(expect, key=str)
    assert sorted(((r.doc_id, r.n_words, r.longest) for r in out), key=str) == sorted(brute_longest(docs), key=str)


def brute_longest(docs, window=50):
    """The greatest doubled window of each document that another document holds too."""
    longest, length = [0] * len(docs), window
    while True:
        owners = {}
        for i, w in docs:
            for k in range(len(w) - length + 1):
                if i is not None:
                    owners.setdefault(tuple(w[k : k + length]), set()).add(i)
        shared = {k for k, v in owners.items() if len(v) > 1}
        for d, (i, w) in enumerate(docs):
            if i is not None and any(tuple(w[k : k + length]) in shared for k in range(len(w) - length + 1)):
                longest[d] = length
        if not shared:
            return [(i, len(w), n) for (i, w), n in zip(docs, longest, strict=True)]
        length *= 2


def test_remove_repeated_levels(spark):
    """Passages cut short, doubled, common to many contexts, inside one document only, and under one id."""
    rnd = random.Random(8)
    w = lambda n: [f"v{rnd.randint(0, 400)}" for _ in range(n)]
    common, long = w(60), w(450)
    docs = [(k, w(rnd.randint(0, 30)) + common + w(rnd.randint(0, 30))) for k in range(20, 60)]
    docs += [(1, long), (2, long[:430] + w(40)), (3, w(10) + long[100:210]), (4, long[300:349]), (5, w(70) * 2), (6, w(30) + long + long), (7, long[:80]), (7, w(5) + long[:90]), (None, long), (8, [])]
    rnd.shuffle(docs)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    for window in (50, 7):
        out = remove_repeated(df, window=window).collect()
        assert sorted(((r.doc_id, r.n_words, r.longest) for r in out), key=str) == sorted(brute_longest(docs, window), key=str)
        first = {}
        for i, t in docs:
            for k in range(len(t) - window + 1):
                if i is not None:
                    first[tuple(t[k : k + window])] = min(i, first.get(tuple(t[k : k + window]), i))
        expect = []
        for i, t in docs:
            gone = [False] * len(t)
            for k in range(len(t) - window + 1):
                if i is not None and first[tuple(t[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
            expect.append((i, " ".join(x for x, g in zip(t, gone, strict=True) if not g)))
        assert sorted(((r.doc_id, r.kept_text) for r in out), key=str) == sorted(expect, key=str)


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    open_, target, left = list(order), {}, 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return target


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_mix_sources(spark, sf_dir, odd, which):
    df = odd if which == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    got = mix_sources(df).collect()
    assert len(got) == df.count()
    target = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert own[0].target == pytest.approx(target[s])
        assert sum(r.taken for r in own) == int(own[0].target)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(3)).collect()))


def test_mix_sources_without_ids(spark, monkeypatch):
    """Rows without id fall into many ranges, and the mix is that of the SQL."""
    import duckdb

    from orthoflux.llm import mixing

    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    rows = [(None if k % 3 else k, "ab"[k % 2], " ".join(["w"] * (k % 7) + [str(k)])) for k in range(200)] + [(None, "a", None), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    documents = df.toArrow()  # noqa: F841
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = duckdb.sql(queries.MIX_SQL).fetchdf()[cols]
    got = mix_sources(df).select(cols).toPandas()
    order = lambda p: p.astype(float).sort_values(cols).reset_index(drop=True)
    assert np.allclose(order(got), order(want), equal_nan=True)


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(write_token_files(odd, path, file_ids=500)).collect())
    at, expect = 0, []
    for i, t in sorted(rows(odd), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        expect.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expect
    enc = WordEncoder(path)
    for text in ("don't<|endoftext|>x", "a b 　c", "İ Σς", "é x́y", "\x1cq \x85", "12'll 😀", "​﻿ z", "a\x00b"):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], [1, 5, 5, 1000, 10**12], list(range(3000)), [3] * 700 + [10**6], [0] * 5000 + [10**9] * 5000])
def test_elias_fano(values):
    e = EliasFano.from_bytes(EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert e.select_range(0, len(values)).tolist() == values and [e.select(i) for i in range(len(values))] == values
    assert all(e.select_range(i, min(i + 300, len(values))).tolist() == values[i : i + 300] for i in range(0, len(values), 97))
    assert e.samples.dtype.itemsize == 4 and len(e.samples) == -(-len(values) // 256)
    with pytest.raises(IndexError):
        e.select(len(values))


def test_overlaps(spark):
    rnd = random.Random(1)
    w = lambda: f"w{rnd.randint(0, 500)}"
    item = [w() for _ in range(40)]
    changed = [x if k % 9 else "zz" for k, x in enumerate(item)]
    clean = [w() for _ in range(3000)]
    docs = [(1, " ".join(clean)), (2, " ".join(clean[:50] + item + clean[50:80])), (3, " ".join(clean[:7] + changed).upper()), (4, ", ".join(item[10:34])), (5, None), (None, " ".join(item)), (6, " ".join(item[:8]))]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(70, " ".join(item), 1), (71, "too short", 1), (72, None, 1)], "item_id long, text string, seed long")
    got = {r.doc_id: r for r in find_overlaps(df.drop("item_id"), items).collect()}
    assert set(got) == {2, 3, 4}
    assert (got[2].doc_word, got[2].n_words, got[2].n_equal) == (50, 40, 40)
    assert got[4].n_equal == 24
    assert {r.doc_id for r in drop_contaminated(df, items).collect()} == {1, 5, None, 6}
    assert find_overlaps(df.limit(0), items).count() == 0 and find_overlaps(df, items.limit(0)).count() == 0


def test_warc(spark):
    pages = [(5, "u", "abc"), (3, None, "abc"), (7, "a\nb", None), (8, "x", ""), (None, "n", "abc"), (9, "z", "é" * 1_500_000), (3, "u", "abc")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, least string")
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    expect = []
    for i, _, h in pages:
        body, top = (h or "").encode(), least[h or ""]
        expect.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    got = [tuple(r) for r in read_archives(normalize_archives(write_archives(df))).collect()]
    assert sorted(got, key=str) == sorted(expect, key=str)
    assert read_archives(normalize_archives(write_archives(df.limit(0)))).count() == 0


def test_feistel_and_pseudonyms():
    for n in (1, 2, 10, 97, 1000):
        f = pii.Feistel(b"k", "t", n)
        assert sorted(map(f.apply, range(n))) == list(range(n)) and [f.undo(f.apply(i)) for i in range(n)] == list(range(n))
    p = pii.Pseudonyms(b"k")
    text = "a.b1@x.example.com 4111 1111 1111 1111, 4111111111111111 4111111111111112 DE89370400440532013000 123-45-6789 000-12-3456\n+1 (743) 555-3824 10.0.0.1 300.1.1.1 1990-02-28 2001-02-30"
    out, found = p.replace(text)
    assert [f["kind"] for f in found] == ["mail", "card", "card", "iban", "ssn", "phone", "ip", "date"]
    assert len(re.sub(r"\d", "0", out)) and "4111111111111112" in out and "000-12-3456" in out and "300.1.1.1" in out and "2001-02-30" in out
    for f in found:
        assert out[f["first"] : f["last"]] not in text
    a, b = (re.sub(r"\D", "", out[f["first"] : f["last"]]) for f in found[1:3])
    assert a == b and pii.luhn_digit(a[:-1]) == int(a[-1])
    iban = out[found[3]["first"] : found[3]["last"]]
    assert pii.iban_check(iban[:2], iban[4:]) == iban[2:4]
    assert p.replace(None) == (None, []) and p.replace("") == ("", [])
    assert pii.Pseudonyms(b"k").replace(text)[0] == out and pii.Pseudonyms(b"j").replace(text)[0] != out


def test_pii_query(spark, odd):
    out = pii.pseudonymize(odd, b"k").collect()
    assert len(out) == odd.count() and all(r.clean_text == r.text for r in out)


def test_language_model(spark, odd):
    m = langid.fit(["the cat and the dog ran", "el gato y el perro corren", "die katze und der hund laufen"] * 5, ["en", "es", "de"] * 5)
    lang, score = m.predict(["the dog", "perros gatos", "hunde", None, "", "123 !!"])
    assert lang == ["en", "es", "de", "und", "und", "und"] and (score[3:] == 0).all() and ((score >= 0) & (score <= 1)).all()
    assert langid.predict_languages(odd, m).count() == odd.count()
    assert langid.fit([], []).predict(["x"])[0] == ["und"]


def test_language_accuracy(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in queries.op8_language_id(spark, sf_dir).collect() if r.held_out]
    assert len(got) > 20 and np.mean([docs[r.doc_id] == r.lang_pred for r in got]) > 0.95


def test_toxicity_model(spark, odd):
    rnd = random.Random(2)
    plain = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "no") for b in ("ran", "sel", "tiv", "gop", "hum")]
    make = lambda bad: " ".join([rnd.choice(plain) for _ in range(60)] + ([rnd.choice(["vilest", "vilely", "rotten"]) for _ in range(3)] if bad else []))
    y = np.array([i % 2 for i in range(240)])
    m = toxicity.fit([make(v) for v in y], y, 0.5)
    mild = make(0)
    s = m.score([make(0) for _ in range(20)] + [make(1) for _ in range(20)] + [mild + " vile rottenly", mild, None, ""])
    assert (s[:20] < 0.3).mean() >= 0.85 and (s[20:40] >= 0.3).mean() >= 0.85 and ((s >= 0) & (s <= 1)).all()
    assert s[42] == s[43] < toxicity.THRESHOLD and s[40] > s[41]
    out = toxicity.score_documents(odd, m)
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)
    assert (toxicity.fit(["a"], np.array([1]), 0.2).score(["b", None]) < 0.3).all()


def test_short_items_are_found(spark):
    w = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, " ".join(w[:8])), (3, " ".join(w[20:30])), (4, "?!"), (5, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, "who wrote hamlet"), (2, " ".join(["x"] * 30) + " WHO wrote hamlet, " + " ".join(["y"] * 30)), (3, " ".join(w[:8])), (4, "a b " + " ".join(w[:8]) + " c"),
            (5, " ".join([*w[20:26], "other", *w[27:30]])), (6, "who wrote macbeth"), (7, "one two three four five six eight"), (8, "z one two three four five six seven"), (9, "hamlet"),
        ],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id): (r.doc_word, r.n_words, r.n_equal) for r in find_overlaps(docs, items).collect()}
    assert got == {(1, 1): (0, 3, 3), (2, 1): (30, 3, 3), (3, 2): (0, 8, 8), (4, 2): (2, 8, 8), (5, 3): (0, 10, 9), (8, 5): (1, 7, 7)}


def test_audio_alignment(spark):
    rng = np.random.default_rng(0)
    tune = lambda steps: 0.5 * np.sin(2 * np.pi * np.cumsum(np.repeat(440 * 2 ** (steps / 12), 768)) / 4096)
    a, b = tune(rng.integers(-12, 12, 40)), tune(rng.integers(-12, 12, 40))
    late = np.r_[b[: 192 * 20], a[:20000]] + 0.01 * rng.standard_normal(192 * 20 + 20000)
    wav = lambda x: audio.encode_wav(x, 4096)
    media = spark.createDataFrame([(100, wav(a)), (7, wav(late)), (8, wav(b)), (9, None), (10, b"junk"), (11, wav(a)), (None, wav(a)), (200, wav(a[:500]))], "id long, media binary")
    out = audio.align_recordings(audio.fingerprint_media(media, "id", "media")).collect()
    got = {(r.query_id, r.match_id): r for r in out if r.kind == "alignment"}
    assert set(got) == {(11, 7), (11, 11)}  # 11 and 100 are one class, named by its least id
    assert got[11, 7].offset == 20 and got[11, 7].bit_errors < 0.05 * 32 * got[11, 7].n_frames
    assert sorted((r.match_id, r.query_id) for r in out if r.kind == "member") == [(7, 7), (8, 8), (11, 11), (100, 11)]


def test_audio_alignment_uses_all_places(spark):
    rng = np.random.default_rng(4)
    word = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    q = word(40)
    later = np.r_[np.repeat(q[::-1], 2), word(7), q]  # every integer occurred before, elsewhere
    half = q.copy()
    half[::2] ^= np.uint32(0xFFFFFFFF)  # 20 votes, but half of the bits differ
    near = q ^ np.uint32(1)
    near[5:15] = q[5:15]  # 10 votes and 30 unequal bits
    rows = [(100, q), (1, later), (2, np.r_[half, near]), (3, word(90))]
    prints = spark.createDataFrame([(i, bytearray(f.astype("<u4").tobytes())) for i, f in rows], "id long, fp binary")
    out = audio.align_recordings(prints).where("kind = 'alignment'").collect()
    got = {r.match_id: (r.offset, r.votes, r.n_frames, r.bit_errors) for r in out}
    assert got == {100: (0, 40, 40, 0), 1: (87, 40, 40, 0), 2: (40, 10, 40, 30)}


@pytest.mark.parametrize("pairs", [1 << 20, 5])
def test_audio_votes_against_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(audio, "PAIRS", pairs)
    rng = np.random.default_rng(6)
    for _ in range(30):  # few integers, held for some frames
        make = lambda: np.repeat(rng.integers(0, 4, rng.integers(0, 30)), rng.integers(1, 5)).astype(np.uint32)
        fps, fp = [make() for _ in range(4)], make()
        got = {q: dict(zip(o.tolist(), v.tolist(), strict=True)) for q, o, v in audio.QueryBlock([7, 8, 9, 10], [f.astype("<u4").tobytes() for f in fps]).votes(fp)}
        for q, f in enumerate(fps):
            want = Counter(int(i - j) for i in range(len(fp)) for j in range(len(f)) if fp[i] == f[j])
            assert got.get(q, {}) == {o: v for o, v in want.items() if v >= audio.MIN_VOTES}


def test_encoder_holds_little_beside_its_tables(monkeypatch):
    """Two megabytes of text in one batch: what hashing holds is bounded by the chunk, whatever a batch holds."""
    import tracemalloc

    import pyarrow as pa

    from orthoflux.llm import text

    monkeypatch.setattr(text, "_powers", {})
    enc = WordEncoder(queries.tokenizer_path())
    texts = pa.array([" ".join(f"w{(i * k) % 997}" for k in range(400)) for i in range(1000)])
    assert sum(len(t.as_py()) for t in texts) > 1_800_000
    tracemalloc.start()
    try:
        n = sum(len(own) for own in enc.encode_all(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 0 and peak < 48 << 20


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    model = toxicity.fit([], np.array([]), 0.1)
    assert near_duplicates(none).count() == remove_repeated(none).count() == mix_sources(none).count() == 0
    assert read_token_files(write_token_files(none, queries.tokenizer_path())).count() == 0
    assert toxicity.score_documents(none, model).count() == pii.pseudonymize(none, b"k").count() == 0
    assert audio.align_recordings(spark.createDataFrame([], "id long, fp binary")).count() == 0


def test_near_duplicates_blocks_of_one_group(spark, monkeypatch):
    """More documents than a block holds, linked across blocks only by pairs that no star compares."""
    from orthoflux.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 8)
    rnd = random.Random(11)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(200)]
    docs = []
    for i in range(60):  # a chain: neighbours are alike, ends are not
        own = list(base)
        for k in range(i // 2 * 2, i // 2 * 2 + 8):
            own[(k * 5) % 200] = f"x{i // 2}_{k}"
        if i % 2:
            own[3] = f"y{i}"
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = brute_sets(docs)
    comp = {i: i for i, _ in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {i: find(i) for i in comp}


def test_warc_attempts(spark, odd, monkeypatch):
    """A second attempt at a part, its rows in another order, leaves the archives that the list names as they are."""
    import pyspark

    from orthoflux.llm import storage, warc

    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    archives = write_archives(pages.repartition(1))
    before = {r.uri: open(r.uri.removeprefix("file://"), "rb").read() for r in archives.collect()}
    folder = next(iter(before)).rsplit("/raw/", 1)[0]

    class Again:
        def partitionId(self):  # noqa: N802
            return 0

        def taskAttemptId(self):  # noqa: N802
            return 10**9

    import pyarrow as pa

    rows = pa.RecordBatch.from_pylist([{"id": i, "url": "u", "html": "other", "least": None, "r": False} for i in range(39, -1, -1)])
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Again()))
    assert storage.attempt() == "000000-1000000000"
    list(warc._writer(folder)([rows]))
    monkeypatch.undo()
    assert {u: open(u.removeprefix("file://"), "rb").read() for u in before} == before
    assert sorted(r.page_id for r in read_archives(normalize_archives(archives, keep_source=False)).collect()) == list(range(40))


def clashing(spark, names):
    long = " ".join(["vile words of a long text 4111 1111 1111 1111"] * 120_000)  # over 5 MB
    rows = [(1, "a plain text, mail a.b@example.com"), (None, "no id"), (2, None), (3, ""), (3, "other text of one id"), (4, long), (4, long)]
    return spark.createDataFrame([(*r, *["old"] * len(names)) for r in rows], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))


@pytest.mark.parametrize("case", ["pii", "pii in place", "lang", "tox"])
def test_columns_of_one_name_are_replaced(spark, case):
    lang = langid.fit(["a plain text", "un texto"], ["en", "es"])
    tox = toxicity.fit([], np.array([]), 0.1)
    run, names = {
        "pii": (lambda d: pii.pseudonymize(d, b"k"), ["PII", "clean_text"]),
        "pii in place": (lambda d: pii.pseudonymize(d, b"k", out_col="text"), ["pii"]),
        "lang": (lambda d: langid.predict_languages(d, lang), ["lang_pred", "Score"]),
        "tox": (lambda d: toxicity.score_documents(d, tox), ["score"]),
    }[case]
    df = clashing(spark, names)
    out = run(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() == 7
    assert all(r[0] != "old" for r in out.select(names[0]).collect())
    assert run(df.limit(0)).count() == 0
    assert run(df.withColumnRenamed("doc_id", "a.b")).select("`a.b`").count() == 7


def test_models_learn_the_same_from_odd_tables(spark):
    rows = [(i, f"the cat {i} and dogs" if i % 2 else f"el gato {i} y perros", "en" if i % 2 else "es") for i in range(30)]
    odd_rows = [*rows, *rows[:7], (None, "le chat", "fr"), (3, "the cat again", "en"), (40, None, "en"), (41, "x", None)]
    frames = [spark.createDataFrame(r, "doc_id long, text string, lang string") for r in (odd_rows, odd_rows[::-1])]
    a, b = (langid.fit_from_table(f.repartition(3), sample=20) for f in frames)
    assert a.langs == b.langs == ["en", "es"] and (a.words.logs == b.words.logs).all() and (a.grams[3].keys == b.grams[3].keys).all()
    assert langid.fit_from_table(frames[0].limit(0)).predict(["the cat"])[0] == ["und"]
    labels = spark.createDataFrame([*((i, i % 2) for i in range(30)), (3, 0), (3, 1), (None, 1), (99, 1), (5, None)], "doc_id long, toxic int")
    models = [toxicity.fit_from_tables(f.repartition(3), labels, sample={0: 9, 1: 9}) for f in frames]
    assert (models[0].scores == models[1].scores).all() and models[0].curve == models[1].curve
    assert (toxicity.fit_from_tables(frames[0].limit(0), labels).score(["a"]) < 0.9).all()
    assert (toxicity.fit_from_tables(frames[0], labels.limit(0)).score(["a"]) < toxicity.THRESHOLD).all()


def test_gram_counts_do_not_depend_on_chunks(monkeypatch):
    from orthoflux.llm import subwords

    texts = ["der hund und die katze " * 9, "das haus am see " * 4, "hunde katzen haus"]
    whole = langid.fit(texts, ["de"] * 3)
    monkeypatch.setattr(subwords, "CHARS", 40)
    parts = langid.fit(texts, ["de"] * 3)
    for n in langid.LENGTHS:
        assert (whole.grams[n].keys == parts.grams[n].keys).all() and (whole.grams[n].logs == parts.grams[n].logs).all()


def test_toxicity_held_out(spark, sf_dir):
    """Quality on rows that taught nothing, on the table with enough labels."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in queries.op10_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in y]
    bad, good = ([r.predicted for r in got if y[r.doc_id] == v] for v in (1, 0))
    assert len(bad) >= 30 and np.mean(bad) >= 0.75 and np.mean(good) <= 0.1


def test_pseudonyms_against_brute_force(spark):
    """Every value planted in a known format is replaced wherever it stands, by one value of its own format; nothing else changes."""
    import datetime

    rnd = random.Random(9)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    make = {
        "card": lambda: (lambda b: f"{b[:4]} {b[4:8]} {b[8:12]} {b[12:]}{pii.luhn_digit(b)}")("4" + digits(14)),
        "ssn": lambda: f"{rnd.randint(100, 600)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}",
        "ip": lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
        "date": lambda: (datetime.date(1950, 1, 1) + datetime.timedelta(rnd.randint(0, 20_000))).isoformat(),
        "mail": lambda: f"{rnd.choice('abcd')}{rnd.choice('xyz')}{digits(3)}@host{rnd.randint(1, 9)}.org",
        "iban": lambda: (lambda b: f"DE{pii.iban_check('DE', b)}{b}")(digits(18)),
        "phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
    }
    shape = {
        "card": lambda v: re.fullmatch(r"(\d{4} ){3}\d{4}", v) and pii.luhn_digit(v.replace(" ", "")[:-1]) == int(v[-1]),
        "ssn": lambda v: re.fullmatch(r"\d{3}-\d{2}-\d{4}", v) and v[:3] != "000",
        "ip": lambda v: re.fullmatch(r"\d+(\.\d+){3}", v) and all(int(p) < 256 for p in v.split(".")),
        "date": lambda v: datetime.date.fromisoformat(v),
        "mail": lambda v: re.fullmatch(r"[a-z]{2}\d{3}@host\d\.org", v),
        "iban": lambda v: re.fullmatch(r"DE\d{20}", v) and pii.iban_check("DE", v[4:]) == v[2:4],
        "phone": lambda v: re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", v),
    }
    pool = [(k, f()) for k, f in make.items() for _ in range(12)]
    docs, planted = [], {}
    for i in range(60):
        planted[i] = [rnd.choice(pool) for _ in range(rnd.randint(0, 9))]
        docs.append((i, "".join(f"plain words {rnd.choice(['id 17', 'v2.0', ''])} <{v}>\n" for _, v in planted[i]) + "end."))
    out = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), b"key").collect()}
    map_ = {}
    for i, text in docs:
        assert [f.kind for f in out[i].pii] == [k for k, _ in planted[i]]
        at, rebuilt = 0, ""
        for (kind, value), f in zip(planted[i], out[i].pii, strict=True):
            new = out[i].clean_text[f.first : f.last]
            assert new != value and shape[kind](new), (kind, value, new)
            assert map_.setdefault((kind, value), new) == new
            rebuilt += out[i].clean_text[at : f.first] + value
            at = f.last
        assert rebuilt + out[i].clean_text[at:] == text
    assert len({(k, n) for (k, _), n in map_.items()}) == len(map_)


def brute_overlaps(docs, items, least=12):
    """Best ungapped alignment of every pair by all shifts: (score, length of the item)."""
    out = {}
    for i, d in docs:
        for j, t in items:
            best = 0
            for shift in range(-len(t), len(d)):
                score = 0
                for k in range(max(0, -shift), min(len(t), len(d) - shift)):
                    score = max(score, 0) + (1 if d[k + shift] == t[k] else -1)
                    best = max(best, score)
            if best >= min(least, -(-len(t) * 3 // 4)):
                out[i, j] = best
    return out


@pytest.mark.parametrize("broadcast", [500_000, 3])
def test_overlaps_against_brute_force(spark, monkeypatch, broadcast):
    """What is found is what all shifts of all pairs give, but for few heavily substituted passages."""
    from orthoflux.llm import decontam

    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", broadcast)
    rnd = random.Random(12)
    w = lambda n: [f"t{rnd.randint(0, 3000)}" for _ in range(n)]
    items = [(j, w(rnd.randint(15, 50))) for j in range(12)]
    docs = [(i, w(rnd.randint(0, 60))) for i in range(30)]
    for i in range(30, 130):
        _, t = rnd.choice(items)
        a = rnd.randint(0, len(t) - 13)
        share = rnd.choice([0, 0.05, 0.1, 0.15])
        docs.append((i, w(rnd.randint(0, 20)) + [x if rnd.random() >= share else "zz" for x in t[a : a + rnd.randint(13, 50)]] + w(rnd.randint(0, 20))))
    want = brute_overlaps(docs, items)
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{name} long, text string")
    got = {(r.doc_id, r.item_id): 2 * r.n_equal - r.n_words for r in find_overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert len(want) > 60 and set(got) <= set(want) and all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.97 * len(want)


def brute_alignment(query, other):
    """The most-voted offset of all that pass, by comparing every frame at every offset."""
    best = None
    for offset in range(-len(query) + 1, len(other)):
        a, b = max(0, offset), min(len(other), len(query) + offset)
        x, y = other[a:b], query[a - offset : b - offset]
        votes, bad = int((x & audio.KEY == y & audio.KEY).sum()), int(np.bitwise_count(x ^ y).sum())
        if b - a >= audio.MIN_FRAMES and votes >= audio.MIN_VOTES and bad <= audio.MAX_ERROR * 32 * (b - a):
            key = (votes, -abs(offset), -offset)
            if best is None or key > best[0]:
                best = key, (offset, votes, b - a, bad)
    return best and best[1]


def melody(notes):
    steps = np.repeat(440 * 2 ** (np.asarray(notes) / 12), 768)
    phase = 2 * np.pi * np.cumsum(steps) / 4096
    return 0.5 * np.sin(phase) + 0.1 * np.sin(2 * phase)


def test_audio_recall_on_changed_copies(spark):
    """Noise, another start, a louder copy, an excerpt, a motif played over and over: against all offsets, and in share found."""
    rng = np.random.default_rng(10)
    tunes = [rng.integers(-12, 12, 24) for _ in range(8)]
    tunes[7] = np.tile(tunes[7][:8], 6)  # a loop
    recordings, truth = [], set()
    for i, t in enumerate(tunes):
        x = melody(t)
        recordings.append((100 * (i + 1), x))
        changed = {
            1: x + 0.02 * rng.standard_normal(len(x)),
            2: 0.3 * x,
            3: np.r_[melody(rng.integers(-12, 12, 9)), x],
            4: x[768 * 4 + 100 :],
            5: np.r_[melody(t[:8]), melody(rng.integers(-12, 12, 43)), x],  # its beginning alone, and then the whole
        }
        for k, y in changed.items():
            recordings.append((1000 + 10 * i + k, y))
            truth.add((100 * (i + 1), 1000 + 10 * i + k))
    media = spark.createDataFrame([(i, bytearray(audio.encode_wav(np.clip(x, -1, 1), 4096))) for i, x in recordings], "id long, media binary")
    prints = audio.fingerprint_media(media, "id", "media")
    fps = {r.id: np.frombuffer(r.fp, "<u4") for r in prints.collect()}
    out = audio.align_recordings(prints).collect()
    own = {r.match_id: r.query_id for r in out if r.kind == "member"}  # a copy that is only less loud has the same fingerprint
    got = {(r.query_id, r.match_id): (r.offset, r.votes, r.n_frames, r.bit_errors) for r in out if r.kind == "alignment"}
    want = {(own[q], own[m]): brute_alignment(fps[q], fps[m]) for q in fps if q % 100 == 0 for m in fps}
    assert got == {k: v for k, v in want.items() if v}
    assert sum((own[q], own[m]) in got for q, m in truth) >= 0.9 * len(truth)


def test_audio_blocks(spark, monkeypatch):
    """Queries of several blocks give what those of one block give."""
    rng = np.random.default_rng(3)
    rows = [(25 * i, bytearray(rng.integers(0, 1 << 32, 30, dtype=np.uint32).tobytes())) for i in range(40)]
    rows += [(i + 1, fp) for i, fp in rows[:9]]
    prints = spark.createDataFrame(rows, "id long, fp binary")
    one = sorted(map(str, audio.align_recordings(prints).collect()))
    monkeypatch.setattr(audio, "BLOCK", 3)
    assert sorted(map(str, audio.align_recordings(prints).collect())) == one and len(one) >= 49 + 10


def test_shuffles_are_freed_by_volume(spark, monkeypatch):
    """After so many shuffled bytes, however little time has passed; not before."""
    from orthoflux.llm import storage

    calls = []
    monkeypatch.setattr(storage, "free_shuffles", calls.append)
    monkeypatch.setattr(storage, "_freed", storage._shuffled(spark))
    rows = spark.range(2000).selectExpr("id", "sha2(string(id), 256) AS v").repartition(3, "id")
    storage.materialize(rows, "freed")
    assert storage._shuffled(spark) > storage._freed and not calls
    monkeypatch.setattr(storage, "FREE_BYTES", 10_000)
    storage.materialize(rows, "freed")
    assert len(calls) == 1 and storage._freed == storage._shuffled(spark)
