"""License notices against a comparison of every window with every template."""

import random

import numpy as np
import pytest

from touchline.llm.licenses import (
    CONTAINMENT, MISSED, TEMPLATES, WORDS, Scanner, band_keys, license_report, scan_licenses, shingle_hashes, tokens, window_shape,
)


@pytest.fixture(scope="module")
def scanner():
    return Scanner(TEMPLATES)


def brute(text):
    """(license, template): some window's word shingles hold enough of the template's."""
    words, found = tokens(text), []
    for name, texts in TEMPLATES.items():
        for number, template in enumerate(texts):
            parts = tokens(template)
            want = {tuple(parts[i:i + WORDS]) for i in range(len(parts) - WORDS + 1)}
            width, step = window_shape(len(parts))
            for start in range(0, max(1, len(words)), step):
                window = words[start:start + width]
                held = {tuple(window[i:i + WORDS]) for i in range(len(window) - WORDS + 1)} & want
                if len(held) / len(want) >= CONTAINMENT:
                    found.append((name, number))
                    break
    return sorted(found)


def corpus(seed):
    rng = random.Random(seed)
    filler = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        parts = rng.choices(filler, k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 2)):
            notice = rng.choice([t for group in TEMPLATES.values() for t in group]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = "changed"
            parts[len(parts) // 2:len(parts) // 2] = notice
        texts.append(" ".join(parts))
    return texts


def test_bands_lose_no_match(scanner):
    texts = corpus(1)
    got = scanner.scan(texts)
    assert got == scanner.scan(texts, bands=False) and len(got) > 15
    assert sorted((i, *m) for i, t in enumerate(texts) for m in brute(t)) == sorted(m[:3] for m in got)


def whole(text):
    """As ``brute``, but over all stretches of twice a template's words, whatever windows the operator takes."""
    words, found = tokens(text), []
    for name, texts in TEMPLATES.items():
        for number, template in enumerate(texts):
            parts = tokens(template)
            want = {tuple(parts[i:i + WORDS]) for i in range(len(parts) - WORDS + 1)}
            runs = [tuple(words[i:i + WORDS]) for i in range(len(words) - WORDS + 1)]
            last = 2 * len(parts) - WORDS + 1
            if any(len(want.intersection(runs[i:i + last])) / len(want) >= CONTAINMENT for i in range(len(runs))):
                found.append((name, number))
    return sorted(found)


@pytest.mark.parametrize("name, number, places, many", [
    ("Apache-2.0", 2, [0.5], 8), ("Apache-2.0", 2, [0.34], 5), ("Apache-2.0", 2, [0.5], 12), ("GPL-3.0", 1, [0.5], 12),
    ("MIT", 3, [0.33, 0.66], 2)])
def test_notices_with_words_put_in_are_found_at_every_alignment(scanner, name, number, places, many):
    notice = tokens(TEMPLATES[name][number])
    for place in sorted((int(p * len(notice)) for p in places), reverse=True):
        notice[place:place] = [b"put"] * many
    texts = [f"{'before ' * lead}{b' '.join(notice).decode()}{' after' * 40}" for lead in range(20)]
    got = scanner.scan(texts)
    assert got == scanner.scan(texts, bands=False)
    assert [(t, first) for t, lic, n, _, first, _ in got if (lic, n) == (name, number)] == [(i, i) for i in range(20)]
    assert [(t, lic, n) for t, lic, n, *_ in got] == [(i, *m) for i, t in enumerate(texts) for m in whole(t)]


def test_random_notices_equal_all_stretches(scanner):
    rng, texts = random.Random(5), corpus(2)
    for text in corpus(3):
        parts = text.split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(parts))
            parts[at:at] = ["put"] * rng.randint(1, 12)
        texts.append(" ".join(parts))
    assert [m[:3] for m in scanner.scan(texts)] == [(i, *m) for i, t in enumerate(texts) for m in whole(t)]


def test_bands_follow_from_the_probability(scanner):
    for t in scanner.templates:
        assert 0 < t.similarity < 1 and (1 - t.similarity) ** t.bands <= MISSED < (1 - t.similarity) ** (t.bands - 1)
        assert sum(len(bands.get(i, ())) for bands in scanner.least.values() for i in [scanner.templates.index(t)]) == t.bands


def test_agreement_equals_the_signatures_of_all_windows():
    rng = np.random.default_rng(1)
    for n in (1, 4, 9, 40):
        hashes = rng.integers(0, 30, n).astype(np.uint64)
        for width in (1, 3, 8, 60):
            for band in range(4):
                keys, w = band_keys(hashes, band), min(width, n)
                least = {int(keys[i:i + w].min()) for i in range(n - w + 1)}
                for p in range(n):
                    holds = any(keys[i:i + w].min() == keys[p] for i in range(max(0, p - w + 1), min(p, n - w) + 1))
                    assert Scanner._agrees(hashes, p, width, band) == holds and (not holds or int(keys[p]) in least)


def test_shingles():
    values = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    assert len(shingle_hashes(values[:4], 5)) == 0 and len(shingle_hashes(values[:5], 5)) == 1
    with pytest.raises(ValueError):
        Scanner({"short": ["too few words"]})


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.license, r.template) for r in license_report(docs).collect()}
    want = {(r.doc_id, *m) for r in docs.collect() for m in brute(r.text)}
    assert got == want and want


def test_edge_cases(frame):
    notice = TEMPLATES["MIT"][0]
    long = "word " * 60_000 + notice + " tail" * 50
    rows = [(1, None), (2, ""), (3, "two words"), (4, notice.upper()), (4, notice.upper()), (None, f"\n{notice}\n"), (5, long),
            (6, notice + " " + notice), (7, "Released under the"), (8, "under the MIT License")]
    docs = frame(rows)
    got = scan_licenses(docs, {"doc_id": docs.doc_id, "license_text": docs.text}).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 4, 4, 5, 6]
    assert all(r.license == "MIT" and r.containment == 1.0 and r.windows >= 1 for r in got)
    assert license_report(frame([])).count() == 0
