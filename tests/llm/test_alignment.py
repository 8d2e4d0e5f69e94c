import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm.conftest import ODD, sample
from repoloom.llm import alignment
from repoloom.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TRICKY = [
    "plain words, and a few more; don't stop",
    "  two  spaces   and three ",
    "line\nfeeds\n\n  mixed \n with spaces\n",
    "tab\tand   other　blanks\r\n",
    "<|endoftext|> <s> </s> <0x0A> <unk>",
    "a▁b",
    "▁",
    " ",
    "   ",
    "\n",
    "\n\n x",
    "日本語のテキスト 🙂🙂 ñandú́",
    "12345 6789.01 a1b2",
    "=" * 300 + " " * 50 + "-" * 77,
    "a\u0000b",
]


def by_hand(rows):
    """Whole texts through both libraries; every link written out."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letter = {c: n for n, c in enumerate(alignment._byte_letters())}
    names = {i: n for n, i in a.get_vocab().items()}
    found, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            whole = f" {text}"
            tokens_a = [
                (i, bytes(letter[c] for c in names[i])) for i in a.encode(whole, add_special_tokens=False).ids
            ]
            tokens_b = []
            for i in b.encode(text):
                p = b.id_to_piece(i)
                tokens_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
            if all(b"".join(x for _, x in t) == whole.encode() for t in (tokens_a, tokens_b)):
                groups = cut(tokens_a, tokens_b)
        links = [(i, j) for own_a, own_b in groups for i in own_a for j in own_b]
        counts.update(set(links))
        found.append((doc_id, groups, links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    rows = []
    for doc_id, groups, links in found:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append(
            (
                doc_id,
                sum(len(x) for x, _ in groups),
                sum(len(y) for _, y in groups),
                len(groups),
                len(links),
                sum(counts[x] == best[x[0]] for x in links),
                sum(counts[x] for x in links),
                hashlib.sha256(shown.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(rows, key=repr)


def cut(tokens_a, tokens_b):
    groups, own, at = [], ([], []), [0, 0]
    queues = list(tokens_a), list(tokens_b)
    while queues[0] or queues[1]:
        side = 0 if queues[0] and (at[0] <= at[1] or not queues[1]) else 1
        i, body = queues[side].pop(0)
        own[side].append(i)
        at[side] += len(body)
        if at[0] == at[1] and own[0] and own[1]:
            groups.append(own)
            own = ([], [])
    return groups


@pytest.mark.parametrize("block", [4 << 20, 500])
def test_equals_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in sample(spark).limit(60).collect()]
    rows += [(7000 + i, t) for i, t in enumerate(TRICKY)] + ODD + [(8000 + i, rows[0][1]) for i in range(40)]
    got = sorted((tuple(r) for r in alignment.align(documents(rows), *PATHS).collect()), key=repr)
    assert got == by_hand(rows)


def test_empty_table(spark, documents):
    assert alignment.align(documents([]), *PATHS).count() == 0
    assert [r.n_a for r in alignment.align(documents([(1, None), (2, "")]), *PATHS).collect()] == [0, 0]


def test_parts_give_the_ids_of_whole_texts(spark):
    """Also for texts whose parts were never seen together."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    aligner = alignment.Aligner(*PATHS)
    texts = [f" {r.text}" for r in sample(spark, scale="sf0.01").collect() if r.text][:600]
    for x in texts:
        parts = aligner._parts(x)
        assert sum((a.encode(p, add_special_tokens=False).ids for p in parts), []) == a.encode(x, add_special_tokens=False).ids
        assert sum(aligner._ids_b(parts), []) == b.encode(x[1:])
