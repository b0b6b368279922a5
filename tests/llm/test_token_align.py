import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm import queries, token_align

FILES = tuple(map(public_tokenizers.path, queries.ALIGNED))
ODD = [
    "a\nb  c <s> <0x0A> é\U0001F600", "\nfoo", "▁x", " ▁ x", "  x", "a\tb", "ﬁ ①  a\t b\u0301 \xa0 　x\x00y\r\n z ",
    "don't we'll 's <|endoftext|>x ", " ", "\n", "\n\n a", "x" * 300 + " " + "漢字かな" * 50 + " ok", "a \n b\n\n\nc   d", "▁",
    "tail ▁ mid", "é" * 100, "\x1c a \x1d b\x85c", "   " * 50 + "x", "\U0001F600" * 90 + " z\n", "if x:\n    return  y\n\tz",
    "\u200b\u200d \u2028 x", "a\u0300 " * 40, "\\n \\x00", "</s><unk>", "a" * 5000, "\x00",
]


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Both:
    """Both tokenizers on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(FILES[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
        self.byte = letters()

    def groups(self, text):
        if not text:
            return None
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in self.a.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, map(self.b.id_to_piece, b))]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        out, one, two, at_a, at_b = [], [], [], 0, 0
        a, b = list(zip(a, bytes_a)), list(zip(b, bytes_b))
        while a or b:
            if at_a <= at_b:
                k, x = a.pop(0)
                one.append(k)
                at_a += len(x)
            else:
                k, x = b.pop(0)
                two.append(k)
                at_b += len(x)
            if at_a == at_b:
                out.append((one, two))
                one, two = [], []
        return out


def plain(rows):
    """The rows of ``aligned`` straight from its definition."""
    both, held, docs = Both(), [], Counter()
    for i, text in rows:
        groups = both.groups(text) or []
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        held.append((i, groups, links))
        docs.update(links.keys())
    top = Counter()
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    out = []
    for i, groups, links in held:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if docs[p] == top[p[0]]), sum(n * docs[p] for p, n in links.items()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return out


def drawn(seed, many=120):
    rng = random.Random(seed)
    words = ["the", "Of", "it's", "é1,", "naïve", "漢字", "\U0001F600!", "<|endoftext|>", "x=1;", "don't", "antidisestablishment", "..."]
    return [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\n\n"]) for _ in range(rng.randint(0, 30)))) for i in range(many)]


@pytest.mark.parametrize("small", [False, True])
def test_follows_the_definition(make, monkeypatch, small):
    rows = drawn(1) + [(1000 + k, t) for k, t in enumerate(ODD)] + [(500, None), (501, ""), (7, "repeated row"), (7, "repeated row"), (None, "no id")]
    if small:
        monkeypatch.setattr(token_align, "BLOCK_PAIRS", 40)
        monkeypatch.setattr(token_align, "REMEMBERED", 20)
        monkeypatch.setattr(token_align, "WRITTEN_OUT", 2)
        monkeypatch.setattr(token_align, "TOGETHER", 30)
    docs = make(rows).withColumn("pair", F.lit("mine")).withColumn("count", F.lit(0)).withColumn("block", F.lit(0)).withColumn("n_a", F.lit(0))
    got = sorted((tuple(r) for r in token_align.aligned(docs, *FILES).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_groups_as_text(make):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(500, None)]
    both = Both()
    want = {i: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in both.groups(t) or []) for i, t in rows}
    assert {r["doc_id"]: r["groups"] for r in token_align.groups(make(rows), *FILES).collect()} == want


def test_stretches_are_encoded_as_in_their_text():
    """Every stretch alone, together with others and in the whole text gives the same groups."""
    own, both = token_align.aligner(*FILES), Both()
    for _, text in drawn(2, 60) + [(0, t) for t in ODD]:
        want = both.groups(text)
        got = own.texts([text])[0]
        alone = own.one(" " + text) if text else None
        assert (want is None) == (got is None) == (alone is None)
        if want is not None:
            assert got[0] == alone[0] == ";".join("+".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
            assert got[1].tolist() == alone[1].tolist() and got[2].tolist() == alone[2].tolist()


def test_no_rows(make):
    assert token_align.aligned(make([], 1), *FILES).count() == 0
