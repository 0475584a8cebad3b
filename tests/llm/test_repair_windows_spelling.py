"""Conversation repair, repeated windows and spelling variants against brute force, and on rows out of the ordinary."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import check
from pairkit.llm import repeated_windows, spelling_variants, turn_repair

CLASHES = ["conv", "turn_", "row_id", "copies", "key1", "key2", "id", "data", "spans", "word", "n", "form", "bucket", "code"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


@pytest.mark.parametrize("name", ["op12_repeated_windows", "op13_spelling_variants"])
def test_query_matches_sql(spark, sf_dir, name):
    assert check.compare(spark, check.connect(sf_dir), name, sf_dir)[0] == "ok"


# ---- 11 conversation repair ----------------------------------------------------
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def cheapest(rows, entry=0, exits=(0, 3)):
    """rows: (initial, cut, doomed, role, text). Plain tables over all prefixes: (cost, audit, turns) of each state."""
    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, out) in list(best.items()):
                to, new = (3, "assistant") if s == 2 else (2, "user")
                found = cost + 2, audit + "I", (*out, (new, ""))
                if to not in best or found[:2] < best[to][:2]:
                    best[to] = found
        return best

    best = inserted({entry: (0, "", ())})
    for initial, cut, doomed, role, text in rows:
        new = {}

        def put(s, found):
            if s not in new or found[:2] < new[s][:2]:
                new[s] = found

        for s, (cost, audit, out) in best.items():
            put(s, (cost + 3, audit + "D", out))
            if not doomed:
                if (initial, s) in NEXT:
                    put(NEXT[initial, s], (cost + cut, audit + "K", (*out, (role, text))))
                put(3 if s == 2 else 2, (cost + cut + 2, audit + "R", (*out, ("assistant" if s == 2 else "user", text))))
        best = inserted(new)
    return {s: best[s] for s in exits if s in best}


def brute_repair(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        convs[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        known = [t for t, _, _ in turns if t is not None]
        seen, marked, faults = set(), [], Counter()
        for _, role, text in turns:
            marks = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role[:1], int(fault == "truncated"), fault in ("blank", "duplicate"), role, text))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, kept = min(cheapest(marked).values())
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def test_search_is_exact_from_every_state_to_every_state():
    rng = random.Random(1)
    for n in [*range(1, 9)] * 40 + [30, 60]:
        runs = tuple((rng.choice([0, 1, 1, 2, 2, 3]) + 4 * (rng.random() < .2) + 8 * (rng.random() < .15), rng.choice([1, 1, 1, 2, 3]))
                     for _ in range(n))
        rows = [("suax"[c & 3], int(c & 4 > 0), c & 8 > 0 or k > 0, "", "") for c, copies in runs for k in range(copies)]
        got = turn_repair.solved(runs, range(4), range(4))
        assert {(e, x): (cost, audit) for e, x, cost, audit, _ in got} == {
            (e, x): v[:2] for e in range(4) for x, v in cheapest(rows, e, range(4)).items()}
        assert all("".join(e for e, _ in edits) == audit and len(edits) == n for _, _, _, audit, edits in got)


def test_bounds_never_exceed_the_cost():
    rng = random.Random(3)
    for _ in range(300):
        runs = [(rng.randrange(16), rng.choice([1, 2])) for _ in range(rng.randint(1, 8))]
        rows = [("suax"[c & 3], int(c & 4 > 0), c & 8 > 0 or k > 0, "", "") for c, copies in runs for k in range(copies)]
        for e in range(4):
            assert turn_repair.suffix_bounds(runs)[0] <= min(v[0] for v in cheapest(rows, e, range(4)).values())


def test_repair_of_odd_and_long_conversations(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, rng.choice([t, t, t, None, t + 5]), rng.choice(["user", "assistant", "user", "assistant", "system", "", "tool", None]),
             rng.choice(["Hi.", "Hi.", "ok", "é? \n", "  ", None, f"x{c}{t}!"])) for c in [*range(40), None] for t in range(rng.choice([1, 2, 5, 9]))]
    rows += [(777, t, ("user", "assistant")[t % 2], f"{t} yes" + rng.choice([".", ""])) for t in range(1500)]  # many blocks
    rows += [(778, 5, "user", "same.")] * 300 + [(779, -2 ** 40, "user", "x" * 100000 + "."), (779, 2 ** 40, "assistant", "y!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    clashing(df).write.parquet(f"{tmp_path}/conversations.parquet")
    got = turn_repair.op11_turn_repair(spark, str(tmp_path))
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repair(rows)


def test_repaired_turns_are_legal_and_an_empty_table_gives_none(spark, sf_dir):
    rows = turn_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = defaultdict(list)
    for r in turn_repair.TurnRepair(rows).turns.collect():
        turns[r.conv].append((r.row_id, r.k, r.role))
    assert turns
    for found in turns.values():
        initials = "".join(role[0] for _, _, role in sorted(found)).removeprefix("s")
        assert initials and initials == "ua" * (len(initials) // 2)
    empty = turn_repair.TurnRepair(rows.limit(0))
    assert empty.summary.count() == 0 and empty.turns.count() == 0 and empty.digests().count() == 0


# ---- 12 repeated windows -------------------------------------------------------
def brute_windows(texts, size):
    data = [(t or "").encode() for t in texts]
    found = Counter(t[i:i + size] for t in data for i in range(len(t) - size + 1))
    out = []
    for t in data:
        covered = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if found[t[i:i + size]] > 1:
                covered[i:i + size] = b"\1" * size
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(t), sum(covered), runs, bytes(c for c, x in zip(t, covered) if not x)))
    return out


def window_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts = [*base, None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 1000, "word " * 200, base[0], base[0], base[1], "日本" * 300]
    for _ in range(60):
        t, u = rng.choice(base), rng.choice(base)
        a, b = sorted(rng.randint(0, len(t)) for _ in range(2))
        c = rng.randint(0, len(u))
        texts.append(u[:c] + t[a:b] + u[c:])
    passage = " ".join(word() for _ in range(50))
    return texts + [f"{word()} {passage} {word() * 5}" for _ in range(30)]


@pytest.mark.parametrize("bucket", [1 << 14, 3])  # the second sends all but the smallest buckets through halving passes
def test_windows_match_brute_force(spark, bucket):
    texts = window_texts()
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).drop("id")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeated_windows.remove_repeats(df, bucket=bucket).collect()}
    assert [got[i] for i in range(len(texts))] == brute_windows(texts, 200)


def test_windows_of_other_sizes_odd_ids_and_empty_tables(spark):
    texts = window_texts()[:40] + ["ab" * 40, "ab" * 30 + "c"]
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeated_windows.remove_repeats(df, threshold=50).collect())
    assert got == sorted(brute_windows(texts, 50))
    assert repeated_windows.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeated_windows.remove_repeats(df, threshold=32)


def test_long_texts_are_anchored_in_slices_without_loss():
    rng = random.Random(7)
    text = bytes(rng.choice(b"abcd") for _ in range(3 * repeated_windows.SLICE // 2))
    one = [c for part in repeated_windows.anchors_of([text], 200) for c in zip(*part)]
    at = sorted(int(c[1]) for c in one)
    assert len(set(at)) == len(at) and max(b - a for a, b in zip(at, at[1:])) <= 200 - repeated_windows.GRAM + 1


# ---- 13 spelling variants ------------------------------------------------------
def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    near = {a: [b for b in words if a != b and abs(len(a) - len(b)) <= 1 and one_apart(a, b)] for a in words}
    form = {}
    for a in words:
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= 10 * words[a] else None

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return sorted(((a, form[a], root(a), words[a], len(near[a]), words.get(form[a])) for a in words), key=repr)


@pytest.mark.parametrize("round_bytes", [32 << 20, 1 << 16])
def test_variants_match_brute_force(spark, monkeypatch, round_bytes):
    if round_bytes < 1 << 20:
        monkeypatch.setattr(spelling_variants, "CHUNK_BLOCKS", 8)
        round_bytes = 1 << 10  # a few chunks a round
    rng = random.Random(8)
    words = {"".join(rng.choice("abcéÿ") for _ in range(rng.randint(7, 8))): rng.choice([2, 3, 25, 400, 5000]) for _ in range(500)}
    words |= {"x" * 300: 3, "x" * 299: 40, "x" * 63: 2, "x" * 64: 2, "x" * 65: 30}
    df = clashing(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    got = sorted((tuple(r) for r in spelling_variants.group_variants(df, round_bytes=round_bytes).collect()), key=repr)
    assert got == brute_variants(words)


def test_spelling_of_odd_documents(spark, tmp_path):
    texts = [(1, None), (2, ""), (None, "Wonderful wonderful"), (3, "wonderful " * 60 + "wonderfuk wonderfuk"), (3, "Ünderful ünderful Ünderful"),
             (4, "a1b2 short wonder×ful wonder×ful"), (5, "z" * 5000 + " " + "z" * 5000)]
    df = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            at = h % len(w)
            counts[w[:at] + w[at + 1:] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = spelling_variants.op13_spelling_variants(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_variants(words) and len(words) > 4
    assert spelling_variants.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_filters_hold_all_their_keys_and_little_else():
    rng = random.Random(9)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(20000)})
    keys = spelling_variants.word_keys(spelling_variants.letters_of(words))
    blocks = spelling_variants.blocks_for(len(words))
    bits = spelling_variants.np.zeros((blocks, spelling_variants.LANES), spelling_variants.np.uint32)
    block = spelling_variants.block_of(keys, blocks).astype("int64")
    for lane in range(spelling_variants.LANES):
        spelling_variants.np.bitwise_or.at(bits, (block, lane), spelling_variants.np.uint32(1) << spelling_variants.lane_bits(keys, lane).astype("uint32"))
    made = spelling_variants.Filter(blocks, 0, bits)
    others = spelling_variants.word_keys(spelling_variants.letters_of(["".join(rng.choice("klmnop") for _ in range(9)) for _ in range(20000)]))
    assert len(made.holds(keys)) == len(keys) and len(made.holds(others)) < 200
