"""Token alignment against nested loops over the tokenizers' own output."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from raincourse.llm import align, blocks
from raincourse.llm.queries import QUERIES, tokenizer
from raincourse.llm.tokens import byte_alphabet
from raincourse.session import sized
from tests.llm.test_operators import docs, none, rows  # noqa: F401


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


def ends(widths):
    return np.cumsum(widths).tolist()


def tokens(sides, text):
    """Ids and token ends of both sides, empty where the octets are not given back."""
    a, b = sides
    one, two, alphabet = a.encode(f" {text}", add_special_tokens=False), b.encode(text), byte_alphabet()
    left = [bytes(alphabet[c] for c in t) for t in one.tokens]
    right = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(two, map(b.id_to_piece, two), strict=True)]
    whole = f" {text}".encode()
    if not text or b"".join(left) != whole or b"".join(right) != whole:
        return [], [], [], []
    return one.ids, two, ends([len(t) for t in left]), ends([len(t) for t in right])


def by_loops(sides, data):
    links, out = Counter(), []
    for doc, text in data:
        ids_a, ids_b, ends_a, ends_b = tokens(sides, text or "")
        of_doc = [(ids_a[i], ids_b[j]) for i in range(len(ids_a)) for j in range(len(ids_b))
                  if max([0, *ends_a][i], [0, *ends_b][j]) < min(ends_a[i], ends_b[j])]
        links.update(of_doc)
        common = sorted(set(ends_a) & set(ends_b))
        spell = ";".join("|".join(",".join(str(k) for k, e in zip(ids, at, strict=True) if low < e <= high) for ids, at in ((ids_a, ends_a), (ids_b, ends_b)))
                         for low, high in zip([0, *common], common, strict=False))
        out.append((doc, len(ids_a), len(ids_b), len(common), of_doc, spell))
    best = Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    return [(doc, na, nb, ng, len(held), sum(links[p] == best[p[1]] for p in held), sum(links[p] for p in held), spell) for doc, na, nb, ng, held, spell in out]


def align_all(frame, block=align.BLOCK):
    found = align.aligned(frame, tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN, tokenizer("piece_bpe_32k.model"), block)
    return align.count_links(sized(found, "aligned")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.mark.parametrize("block", [40, align.BLOCK])
def test_alignment_of_awkward_rows(docs, none, sides, block):  # noqa: F811
    extra = docs.sparkSession.createDataFrame(
        [(50, "<|endoftext|> <s> </s> <unk> <0x41>"), (51, "two  spaces▁ bar"), (52, "two▁bars"), (53, "日本語テキスト🙂 naïve"), (54, "\x00\x01 a"), (55, " lead"), (56, "\n\n\t"), (56, "\n\n\t"), (57, "straße " * 40)],
        "doc_id long, text string")
    every = docs.select("*").unionByName(extra, allowMissingColumns=True).where("length(text) < 2000 OR text IS NULL")
    want = by_loops(sides, rows(every.select("doc_id", "text")))
    assert sorted(rows(align_all(every, block)), key=repr) == sorted(want, key=repr)
    assert any(r[3] < r[1] and r[3] < r[2] for r in want) and any(r[1] == 0 and r[0] == 52 for r in want)
    assert rows(align_all(none, block)) == []


def test_query_on_some_documents(spark, folder, sides):
    some = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 2000").collect()}
    found = QUERIES["op12_alignment"](spark, folder).where(F.col("doc_id").isin(list(some))).collect()
    assert len(found) == len(some) > 20
    for r in found:
        ids_a, ids_b, ends_a, ends_b = tokens(sides, some[r["doc_id"]] or "")
        common = sorted(set(ends_a) & set(ends_b))
        spell = ";".join("|".join(",".join(str(k) for k, e in zip(ids, at, strict=True) if low < e <= high) for ids, at in ((ids_a, ends_a), (ids_b, ends_b)))
                         for low, high in zip([0, *common], common, strict=False))
        assert (r["n_a"], r["n_b"], r["n_groups"]) == (len(ids_a), len(ids_b), len(common))
        assert r["groups_sha256"] == (hashlib.sha256(spell.encode()).hexdigest() if spell else "")


def test_long_chain_collapses():
    ends_a = np.arange(2, 20_001, 2)  # every other octet, so tokens of both sides overlap in one chain to the end
    ends_b = np.append(np.arange(1, 20_000, 2), 20_000)
    a, b = align.Ends(ends_a, 20_000), align.Ends(ends_b, 20_000)
    for group in align.jump(ends_a, ends_b, a, b):
        assert set(group.tolist()) == {0}


def test_numbers_survive_packing():
    values = np.array([0, 1, 255, 256, 70_000, (1 << 32) - 1])
    assert (blocks.unpacked(blocks.packed(values)) == values).all()
    assert len(blocks.unpacked(None)) == 0
