"""Links, groups and counts against a version that looks at every byte of every document."""

import hashlib
from collections import Counter, defaultdict

import pytest
from public_tokenizers import PATTERN, path

from touchline.llm import alignment
from touchline.llm.alignment import Pair, align_documents, chunks, pair_counts, pair_table

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
TEXTS = ["Hello world, hello  again!", "", None, "naïve café 你好 🤗 ünïcode", "a\tb\r\n\n  c", " leading and trailing  ", "<|endoftext|> <s> </s> <0x41>",
         "▁mark", "▁", "x" * 300 + " " + "ab" * 500, "Hello world, hello  again!", "don't we'll 1234567 $$$ ...", "　ideographic\xa0space​",
         "the the the cat " * 40, "nul\x00byte", "ﬁ ligature ½", "\n", " ", "antidisestablishmentarianism uncharacteristically"]


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    pair = Pair(A, B, PATTERN)
    found, docs = [], Counter()
    for text in texts:
        a = a_of.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_of.encode(text or "")
        owner = [[i for i, t in enumerate(ids) for _ in range(len(of[t]))] for ids, of in ((a, pair.first.of), (b, pair.second.of))]
        if not text or any(b"".join(of[t] for t in ids) != (" " + text).encode() for ids, of in ((a, pair.first.of), (b, pair.second.of))):
            found.append(([], [], [], []))
            continue
        links = sorted(set(zip(*owner)))
        cuts = [k for k in range(len(owner[0])) if all(k + 1 == len(o) or o[k + 1] != o[k] for o in owner)]
        groups, i, j = [], 0, 0
        for k in cuts:
            x, y = owner[0][k] + 1, owner[1][k] + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        linked = [(a[i], b[j]) for i, j in links]
        docs.update(set(linked))
        found.append((a, b, groups, linked))
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    return docs, [(len(a), len(b), len(g), len(k), sum(docs[p] == top[p[0]] for p in k), sum(docs[p] for p in k),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, k in found]


@pytest.mark.parametrize("chunk, part", [(4_000_000, 250_000), (60, 20)])
def test_equals_the_byte_by_byte_version(frame, monkeypatch, chunk, part):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(alignment, "PART_PAIRS", part)
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, "a null id")]
    got = sorted(map(tuple, align_documents(frame(rows).repartition(2), A, B, PATTERN).collect()), key=repr)
    _, want = plain([t for _, t in rows])
    assert got == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=repr)
    assert sum(g[1] == 0 for g in got) >= 3 and any(g[3] < min(g[1], g[2]) for g in got)


def test_pair_table_counts_documents(frame):
    rows = list(enumerate(TEXTS))
    counts, _ = pair_counts(chunks(frame(rows), A, B, PATTERN, "doc_id", "text"))
    docs, _ = plain(TEXTS)
    assert {(r.a, r.b): r.docs for r in pair_table(counts).collect()} == dict(docs)


def test_empty_table_and_remembered_windows(frame, monkeypatch):
    assert align_documents(frame([]).limit(0), A, B, PATTERN).count() == 0
    pair, text = Pair(A, B, PATTERN), "one two three one two three"
    (a, b), = pair.encode([text])
    first = pair.windows(a, b)
    assert len(pair.known) == 3 and first[:3] == first[3:]
    assert pair.figures([first])[:2] == ([6], [len(a)]) and len(a) == len(b)
    monkeypatch.setattr(alignment, "WINDOW_IDS", 1)
    again = Pair(A, B, PATTERN)
    assert again.figures([again.windows(a, b)])[:3] == pair.figures([first])[:3] and not again.known


def test_first_vocabulary_equals_the_library():
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(A), alignment.First(A, PATTERN)
    whole.encode_special_tokens = True
    texts = [" " + (t or "") for t in TEXTS]
    assert fast.encode(texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
