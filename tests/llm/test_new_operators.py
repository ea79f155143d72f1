"""Hard negatives, chat formatting and the filter audit against brute force and planted cases."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest

from fathomline.llm import chat_format, filter_audit, hard_negatives

from .helpers import WORDS

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def negatives_by_force(rows, every=50):
    """What contract_negatives gives, by scoring every anchor with every row."""
    used = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), (label + 1) % 10 if i % 7 == 0 else label))
    width = max((len(q) for _, q, _ in used), default=0)
    used = [(i, np.pad(q, (0, width - len(q))), label) for i, q, label in used]
    out = []
    for a, (i, q, label) in enumerate(used):
        if i % every:
            continue
        scored = sorted((-int(q @ x), j, m == label) for b, (j, x, m) in enumerate(used) if a != b)
        for p, j, _ in [s for s in scored if s[2]][:5]:
            fit = [(n, x) for n, x, same in scored if not same and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, j, r, x, -p, -n) for r, (n, x) in enumerate(fit, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_hard_negatives(spark, monkeypatch):
    """Small lists, shards, blocks and tiles, many ties, one very common vector, unusable rows, repeated ids and short vectors."""
    for name, value in (("SHARD_ROWS", 40), ("BLOCK_ANCHORS", 4), ("TILE_ROWS", 16), ("TILE_ANCHORS", 3), ("FIRST_LISTS", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(k, [float(x) for x in np.float32(centres[k % 6] + 0.3 * rng.normal(size=8)).round(1)], int(rng.integers(4))) for k in range(400)]
    rows += [(k, [0.5] * 8, k % 3) for k in range(400, 520)]
    rows += [(550, None, 1), (600, [1.0, None] * 4, 1), (650, [float("nan")] * 8, 2), (700, [float("inf")] * 8, 2), (750, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    rows += [rows[50], rows[50], rows[60], (100, [0.1] * 8, 1), (800, [0.5, 0.5], 2), (801, [], 3), (850, [0.0] * 8, 2)]
    table = spark.createDataFrame(rows, EMBEDDINGS)
    want = negatives_by_force(rows)
    assert len(want) > 100 and found(hard_negatives.contract_negatives(table)) == want
    extra = table.selectExpr("*", "1 AS shard", "2 AS list", "3 AS q", "'x' AS `a.b`", "4 AS anchor")
    assert found(hard_negatives.contract_negatives(extra)) == want
    assert hard_negatives.contract_negatives(table.limit(0)).count() == 0


def test_long_vectors_are_multiplied_exactly(spark):
    rows = [(50 * k, [float(2**17 + k) * (1 - 0.2 * (k % 2)), 3.0 + k / 256], 1 + k % 2) for k in range(8)]
    assert found(hard_negatives.contract_negatives(spark.createDataFrame(rows, EMBEDDINGS))) == negatives_by_force(rows) != []


def test_lists_are_left_out(spark, monkeypatch):
    """Clusters far apart: most rows are never scored, and the results are those of a full scan."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in np.eye(16)[k % 16] + 0.02 * rng.normal(size=16)], k % 16 % 8) for k in range(3200)]
    usable = hard_negatives.usable(spark.createDataFrame(rows, EMBEDDINGS))
    table, lists = hard_negatives.build_index(usable)
    upper, lower = lists.bounds(np.stack([np.array(r.q, float) for r in usable.limit(50).collect()]))
    assert table.count() == 3200 and (upper < 20_000).mean() > 0.8
    for r in table.limit(200).collect():
        q = np.frombuffer(r.q, lists.dtype).astype(float)
        u, v = lists.bounds(q[None])
        assert v[0, r.list] <= q @ q <= u[0, r.list]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    pieces = [*chat_format.CONTROLS, "\\", "<", "[", "/s>", "S>>", "é", "😀", " ", "\n", "a", "<\\/s>", "INST]", ""]
    rows = []
    for c in [*range(30), None]:
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "system", "tool", "[/ROLE] x\n", "", None])
            rows.append((c, t if rng.random() < 0.9 else None, role, None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))))
    rows += rows[:5] + [(40, k, "assistant", "x" * 5000 + "</s>é") for k in range(3)]
    shuffled = rng.sample(rows, len(rows))
    formatted = chat_format.format_conversations(spark.createDataFrame(shuffled, CONVERSATIONS).selectExpr("*", "1 AS part", "2 AS `a.b`", "3 AS formatted"), slice_bytes=300)
    want = {}
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for c in {r[0] for r in rows}:
        want[c] = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
    parts = sorted(formatted.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.part))
    got, loss = {}, {}
    for p in parts:
        turns = list(chat_format.parse(p.formatted))
        got.setdefault(p.conv_id, []).extend(turns)
        loss.setdefault(p.conv_id, []).extend(chat_format.unescape(p.formatted[a:b]) for a, b in p.loss)
        marks = sum({"system": 2, "user": 3, "assistant": 1}.get(r, 3) for r, _ in turns)
        assert sum(p.formatted.count(c) for c in chat_format.CONTROLS) == marks  # none left whole inside a text or role
    assert got == want and loss == {c: [t for r, t in turns if r == "assistant"] for c, turns in want.items()}
    assert max(p.part for p in parts) > 0 and sorted({p.part for p in parts if p.conv_id == 40}) == [0, 1]
    for r in chat_format.read_back(formatted).unionByName(chat_format.read_back(formatted.repartition(3), stored=True)).collect():
        turns, said = want[r.conv_id], "".join(t for who, t in want[r.conv_id] if who == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == sum(len(p.formatted) for p in parts if p.conv_id == r.conv_id)


def test_chat_hostile_and_empty(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert chat_format.format_conversations(none).count() == 0 and chat_format.read_back(chat_format.format_conversations(none)).count() == 0
    (one,) = chat_format.format_conversations(chat_format.with_hostile(none)).collect()
    assert list(chat_format.parse(one.formatted)) == [("user", chat_format.HOSTILE), ("assistant", chat_format.HOSTILE)]
    with pytest.raises(ValueError):
        list(chat_format.parse("no turn"))


def audit_by_force(docs, labels):
    text_ids = {}
    for d, t, _ in docs:
        if d is not None:
            text_ids.setdefault(t or "", []).append(d)
    rows = []
    for d, t, source in docs:
        text = t or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and any(x < d for x in text_ids[text]),
        }
        rows.append((source or "", fails, any(i == d and q == 1 for i, q, _ in labels if d is not None), any(i == d and x == 1 for i, _, x in labels if d is not None)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                mine = [r for r in rows if r[0] == part and r[1][f]]
                out[part, order, k] = [len(left), len(gone), len(mine) - len(gone), sum(sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(6)
    texts = [" ".join(f"{'W' if rng.random() < shout else 'w'}ord{rng.randrange(many)}" for _ in range(rng.choice([5, 199, 200, 260]))) for shout in (0, 0.3) for many in (50, 900) for _ in range(8)]
    texts += [None, "", "", "  \t ", "a#b", "Ab " * 250, "x " * 100_000, "naïve $ " * 120]
    docs = [(rng.choice([k, k, None, 3]), t, rng.choice(["s", "t", None, ""])) for k, t in enumerate([*texts, *texts[:20]])]
    docs += [docs[0]] * 3
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [*range(40), None, 3, 3, 99_999]]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS A", "3 AS words", "4 AS `a.b`")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(table, marks).collect()}
    assert got == audit_by_force(docs, labels) and len(got) == 3 * 600
    assert filter_audit.audit(table.limit(0), marks).count() == 0
