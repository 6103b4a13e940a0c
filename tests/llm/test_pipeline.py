"""The stages of the pipeline as it calls them."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from conftest_llm import odd_rows
from ragtide.llm import toxicity
from test_other_operators import toxic_corpus
from test_set_join import LOWER
from test_text_operators import contamination_by_hand, lines_by_hand


def test_packing_carries_the_ids(spark):
    """The last stage's rows join up to every document's ids, each ended by id 2; digests stand beside them."""
    texts = ["one two three.", "", None, "end <|endoftext|> start", "word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in sorted(p.pack(spark, docs, "").collect(), key=lambda r: (r.doc_id, r.start)):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def decision_by_hand(word, model):
    """The largest value of a word's windows, from the definition: every subsequence, one at a time."""
    best = model.bias
    for x in toxicity.windows_of(toxicity.folded(word)) if len(toxicity.folded(word)) > 3 else []:
        codes, total, norm = toxicity.letter_codes([x])[0].tolist()[: len(x)], 0.0, 0.0
        for i in range(len(codes)):
            for gaps in toxicity.GAPS:
                if i + gaps[-1] < len(codes):
                    number, w = 0, toxicity.DECAY ** (gaps[-1] + 1)
                    for g in gaps:
                        number = number * toxicity.CODES + codes[i + g]
                    total, norm = total + w * float(model.weights[number]), norm + w * w
        best = max(best, model.bias + (total / norm ** 0.5 if norm else 0.0))
    return best


def test_every_stage_by_hand(spark, tmp_path):
    """Each stage against brute force over what its predecessor left, row by row: nulls, repeated rows, near copies,
    shared lines, benchmark passages and toxic texts."""
    toxic, labels = toxic_corpus(160)
    odd = [r[:2] for r in odd_rows()]
    item = " ".join((odd[25][1] or "").split()[18:40])
    near = odd[14][1].split()
    rows = odd + [(i + 1000, t) for i, t in toxic] + [(None, " ".join([*near[:30], "edited", *near[31:]])), (500, "a<|endoftext|>b"), (500, "a<|endoftext|>b")]
    folder = str(tmp_path)
    spark.createDataFrame([(i + 1000, y) for i, y in labels], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, item), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    def after(stage, rows):
        out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder)
        assert out.columns == ["doc_id", "text"]
        return [tuple(r) for r in out.collect()]

    # toxicity: the same model, every word scored alone
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.toxicity_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    known = {}

    def clean(text):
        low = (text or "").lower()
        words = set(low.split()) | {m.replace(" ", "") for m in toxicity._SPELLED.findall(low)}
        known.update({w: decision_by_hand(w, model) for w in words - known.keys()})
        values = sorted((known[w] for w in words), reverse=True)
        return float(model.score(np.array([(values + [model.bias] * toxicity.TOP)[: toxicity.TOP]]))[0]) < 0.7

    left = after(p.drop_toxic, rows)
    assert Counter(left) == Counter(r for r in rows if clean(r[1])) and len(left) < len(rows)

    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    lines = after(p.dedup_lines, left)
    want = lines_by_hand(left)
    assert Counter((d, sha(t)) for d, t in lines) == Counter((r[0], r[3]) for r in want) and sum(r[2] for r in want)

    kept = after(p.dedup_documents, lines)
    sets = []
    for _, t in lines:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(lines)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and group[i] != group[j] and 100 * len(a & b) >= 80 * len(a | b):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    stay, n = Counter(kept), Counter()
    for g in set(group):
        members = [r for r, own, s in zip(lines, group, sets) if own == g and s]
        if members:
            low = min(members, key=lambda r: (r[0] is None, r[0] or 0))[0]
            here = [r for r in set(members) for _ in range(stay[r])]
            assert len(here) == 1 and here[0][0] == low, members
            n.update(here)
    n.update(r for r, s in zip(lines, sets) if not s)
    assert stay == n and len(kept) < len(lines)

    pure = after(p.drop_contaminated, kept)
    assert Counter(pure) == Counter(r for r in kept if not contamination_by_hand([r], items)[0][-1]) and len(pure) < len(kept)

    library, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    packed = p.pack(spark, spark.createDataFrame(pure, "doc_id long, text string").repartition(3), folder).collect()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            got.append((r.doc_id, []))
        got[-1][1].extend(np.frombuffer(r.ids, "<u4").tolist())
    assert Counter((d, tuple(x)) for d, x in got) == Counter((d, (*library.encode(t or "", add_special_tokens=False).ids, 2)) for d, t in pure)
