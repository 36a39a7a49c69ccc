from __future__ import annotations

import fnmatch
import hashlib
import re

import numpy as np
import pytest

from lodeseek.llm import imatch as I
from lodeseek.llm import license_scan as L
from lodeseek.llm import url_filter as U
from tests.llm.conftest import CLASHING, frame, prose


def brute_url(url, rules=U.RULES):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_urls_match_brute_force(spark, rng):
    parts = ["http", "://", "a.", "example", ".com", ".net", ".org", "com", "/en/", "/en/7", "/de/", "/de/8", "/es/", "?", "#", "/", "X", "é", "ſ", "x" * 300]
    urls = [None, "", "//", "http://COM/en/", "http://xcom/en/", "http://a.net?x=/de/", "http://b.org#/es/", "http://q.net/x.com/en/a"]
    urls += ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(700)]
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, id string")
    got = {r.id: r for r in U.judge(pages).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert verdict is None or got[i].verdict == verdict
    assert U.judge(pages.limit(0)).count() == 0


def test_the_rules_are_those_of_the_contract(spark):
    """Written out here, not read from the module: the verdict of each rule, and that of the longest where several fit."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://x.example.com/en/8": ("com/en/", "block"),
        "http://a.net/de/1": ("net/de/", "allow"), "http://NET/de/": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://x.example.net/de/81": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"), "http://casino.net/de/a.zip": ("net/de/", "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    assert {r.id: (r.rule, r.verdict) for r in U.judge(pages).collect()} == dict(enumerate(want.values()))


def test_automaton_is_glob_matching(rng):
    """Many patterns over several words of the mask, against a plain glob matcher."""
    globs = ["".join(rng.choices("ab*?.", k=rng.randint(0, 9))) for _ in range(120)]
    texts = ["".join(rng.choices("ab.", k=rng.randint(0, 12))) for _ in range(200)]
    machine = U.compile_patterns([U.glob(g) for g in globs])
    assert machine.step.shape[1] > 3
    got = U.simulate(machine, [t.encode() for t in texts])
    want = [[re.fullmatch(fnmatch.translate(g.replace("[", "[[]")), t) is not None for g in globs] for t in texts]
    assert got.tolist() == want


def brute_license(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    places, labels = [], set()
    for t in L.PHRASES:
        p = t.words
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {t.label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, rng, oddities):
    gpl = next(t for t in L.PASSAGES if t.label == "gpl").words
    bsd = next(t for t in L.PASSAGES if t.label == "bsd").words
    texts = [
        "Under the MIT License, or CC-BY; cc by", "gnu General  Public-license gnu general public", prose(rng, 300) + " Apache License apache license mit", prose(rng, 200),
        " ".join(bsd[:9] + ["inserted"] + bsd[9:]), " ".join(bsd[:4]), "x " + " ".join(gpl), " cc", "by cc by cc by", *oddities,
    ]
    docs = frame(spark, texts, CLASHING)
    got = {r.id: r for r in L.scan(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute_license(text), (i, text)
        assert 0 <= got[i].score <= 1 and set(got[i].base_labels.split(",")) - {""} <= set(got[i].labels.split(","))
    assert got[4].labels == "bsd" and got[4].base_labels == "" and got[5].labels == "" and got[6].labels == "gpl"
    assert L.scan(docs.limit(0)).count() == 0
    assert L.scan(docs.unionByName(docs)).count() == 2 * len(texts)


def test_license_templates_and_grams_are_inputs(spark, rng):
    """Passages of 300 words from a table, by grams of 2, 4 and 7 words: whole and lightly edited ones are found at their places, strangers
    not; repeats a thousand times over, and phrases beside them, as with pairs."""
    passages = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(5)]
    rows = [(f"p{i}", t, False) for i, t in enumerate(passages)] + [("mit", "MIT license", True), ("x", None, False)]
    templates = L.templates_of(spark.createDataFrame([*rows, rows[0]], "label string, text string, is_phrase boolean"))
    assert [t.label for t in templates] == ["mit", "p0", "p1", "p2", "p3", "p4"]
    words = passages[1].split()
    edited = words[:70] + ["new"] + words[70:140] + words[141:220] + ["other"] + words[221:]
    texts = [prose(rng, 50) + " " + passages[0] + " MIT license", " ".join(edited), prose(rng, 400), " ".join([passages[2]] * 200), " ".join(words[:100]), None]
    for k in (2, 4, 7):
        got = {r.id: r for r in L.scan(frame(spark, texts, CLASHING), templates, k).collect()}
        assert got[0].labels == "mit,p0" and got[0].base_labels == "mit" and got[0].first_word == 350 and got[1].labels == "p1"
        assert [got[i].labels for i in (2, 4, 5)] == ["", "", ""] and 0.2 < got[4].score < 0.6
    many = [L.Template("x", " ".join(["a"] * (L.MAX_TEMPLATE_WORDS + 5)), False)]
    with pytest.raises(ValueError):
        L.scan(frame(spark, texts), many)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_imatch_compares_neighbours(spark, rng, n):
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(n)]
    docs = frame(spark, texts, CLASHING)
    got = {r.id: r for r in I.compare_with_next(docs, target_bytes=400).collect()}
    order = sorted(range(n), reverse=True)
    for k, i in enumerate(order):
        after = texts[order[(k + 1) % n]]
        changed = I.edited(texts[i], after)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(texts[i])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if texts[i] == after:
            assert got[i].near_next == 1.0


def test_imatch_odd_rows(spark, oddities):
    docs = frame(spark, oddities, CLASHING)
    got = I.compare_with_next(docs.unionByName(docs), target_bytes=100_000).collect()
    assert len(got) == 2 * len(oddities)
    by = {}
    for r in got:
        by.setdefault(oddities[r.id] or "", set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by.values())
    assert I.compare_with_next(docs.limit(0)).count() == 0


def test_likeness_parts_edits_from_strangers(rng):
    s = I.Settings()
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(rng.randint(30, 3000))) for _ in range(80)]
    terms, df = np.unique(np.concatenate([I.hashes_of(t.encode(), s) for t in texts]), return_counts=True)
    lexicon = I.Lexicon.of(terms[df < 60])
    fps = [I.fingerprint(t.encode(), lexicon, s) for t in texts]
    near = [I.likeness(f, I.fingerprint(I.edited(t, u).encode(), lexicon, s)) for f, t, u in zip(fps, texts, texts[1:])]
    far = [I.likeness(a, b) for a, b in zip(fps, fps[1:])]
    assert np.mean([a > b for a, b in zip(near, far)]) >= 0.95 and np.mean(near) > 0.3 > np.mean(far)


def brute_fingerprint(text, kept, s):
    """By the definition: of each subset, which a term is in if bits of its mixed hash are clear, the mixed hashes summed."""
    import xxhash

    words = {w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w}
    words = {xxhash.xxh32_intdigest(w.encode(), s.seed) for w in words if w in kept}
    odd, sparse = (x.tolist() for x in I.subset_keys(s))
    out = []
    for k, mask in zip(odd, sparse):
        total = 0
        for h in sorted(words):
            m = h * k % 2**64
            m = (m ^ (m >> 31)) * 0x9E3779B97F4A7C15 % 2**64
            total += m if not (m >> 40) & mask else 0
        total %= 2**64
        total ^= total >> 32
        out.append(0 if total == 0 else (total >> 7) % 2**16 | 1)
    return np.array(out, dtype=np.uint16).reshape(s.scales, s.subsets)


def test_imatch_fingerprints_match_brute_force(spark, rng, oddities):
    """Terms in the band by counting, fingerprints by definition, whatever the size of blocks; near_* are their likeness."""
    s = I.Settings(max_df_share=0.3)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{int(rng.paretovariate(0.4)) % 4000}" for _ in range(rng.randint(1, 2500))) for _ in range(25)] + oddities
    df = {}
    for t in texts:
        for w in {w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w}:
            df[w] = df.get(w, 0) + 1
    kept = {w for w, n in df.items() if 2 <= n <= int(0.3 * len(texts))}
    got = {r.id: r for r in I.compare_with_next(frame(spark, texts, CLASHING), s, target_bytes=50_000).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(texts)]] or ""
        fp, changed = brute_fingerprint(own, kept, s), brute_fingerprint(I.edited(own, after), kept, s)
        assert got[i].fingerprint == I.written(fp) and got[i].edited_fingerprint == I.written(changed), i
        assert got[i].near_edited == I.likeness(fp, changed) and got[i].near_next == I.likeness(fp, brute_fingerprint(after, kept, s))


def test_very_long_urls_are_read_whole_and_in_bounds(rng):
    """URLs of 300 kB and 3 MB beside short ones: as by the block-wise simulation of each alone, in bounded memory."""
    import tracemalloc

    globs = ["*casino*", "*/login*", "*.exe", "a*b?c", "*" + "x" * 70 + "*"]
    machine = U.compile_patterns([U.glob(g) for g in globs])
    urls = [b"a.b/login", b"", b"z" * 300_000 + b"casino" + b"y" * 3_000_000, b"q" * 20_000 + b".exe", b"x" * 9_000, b"ab" + b"-" * 9_000 + b"b1c"] + [b"u%d" % i for i in range(600)]
    tracemalloc.start()
    got = U.simulate(machine, urls)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    want = [[re.fullmatch(fnmatch.translate(g), u.decode(), re.DOTALL) is not None for g in globs] for u in urls]
    assert got.tolist() == want


def test_rules_and_globs_from_tables(spark, rng):
    """Hundreds of rules and globs given as tables, nulls and repeats among them, against a plain matcher."""
    hosts = ["".join(rng.choices("ab.", k=rng.randint(1, 5))).strip(".") or "a" for _ in range(150)]
    rules = [(rng.choice(("allow", "block")), h, "/" + "".join(rng.choices("xy/", k=rng.randint(0, 3)))) for h in hosts]
    rules = list({r[1:]: r for r in rules}.values())
    globs = sorted({(f"*{''.join(rng.choices('ab', k=rng.randint(1, 4)))}*", rng.choice(("*", "*/x*", "*y"))) for _ in range(300)})
    found = U.tables(
        spark.createDataFrame([*rules, rules[0], (None, "a", "/")], "verdict string, host string, path string"),
        spark.createDataFrame([*globs, globs[0], (None, "*")], "host string, path string"),
    )
    assert sorted((r.verdict, r.host, r.path) for r in found[0]) == sorted(rules) and found[1] == globs
    urls = [f"http://{''.join(rng.choices('ab.', k=rng.randint(0, 7)))}/{''.join(rng.choices('xy/', k=rng.randint(0, 5)))}" for _ in range(300)]
    got = {r.id: r for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), *found).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u, found[0])
        fits = any(re.fullmatch(fnmatch.translate(h), host) and re.fullmatch(fnmatch.translate(p), path) for h, p in globs)
        longest = max((len(r.name) for r in found[0] if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), default=None)
        assert longest is None or len(got[i].rule) == longest
        if rule is None:
            assert got[i].rule is None and got[i].verdict == ("block" if fits else "allow"), u
