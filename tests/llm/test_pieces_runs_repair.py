"""SentencePiece agenda, periodic runs and conversation repair against the library, brute force and plain Python."""

import collections
import hashlib
import random
import re
import zlib
from array import array
from functools import cache

import public_tokenizers
import pytest

from cairn.llm import conversation_repair as repair
from cairn.llm import periodic_runs, sentence_pieces
from tests.llm.test_operators import base_text

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a ", "▁", " ▁ ▁▁x", "\n\n a\n b", "日本語 テキスト　x", "<s> </s> <0x41> <unk>", "é́ é ﬁ ²." * 3, "a\x00b �", "x" * 3000, "ab" * 2000, " " * 500, "😀 the 😀", "don't 3.14!!"]


# ---- 11


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.MergePieces(PATH, memory=50)


def both_ways(pieces, text):
    want = pieces.library.encode(text, add_bos=True, add_eos=True)
    got = pieces.encode(text)
    assert got == array("I", want).tobytes(), text
    assert pieces.decode(got) == pieces.library.decode(want)


def test_pieces_are_the_librarys(pieces):
    r = random.Random(1)
    for text in [*ODD, base_text(3, 400), *["".join(r.choice("  ▁\nabcthein,.é日😀́") for _ in range(r.randrange(40))) for _ in range(2000)]]:
        both_ways(pieces, text)
    assert len(pieces.parts.old) < 1000


def test_any_ids_decode_as_the_library_does(pieces):
    r, some = random.Random(2), [0, 1, 2, 259, 28705, *(3 + b for b in (0xE3, 0x81, 0x82, 0xF0, 0x9F, 0xED, 0xA0, 0xF4, 0x61))]
    for _ in range(5000):
        ids = [r.choice([*some, r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randrange(9))]
        assert pieces.decode(array("I", ids).tobytes()) == pieces.library.decode(ids), ids


def test_agenda_takes_the_best_pair_then_the_leftmost(pieces):
    cost = pieces.order

    def slow(part):
        s = list(part)
        while pairs := [(cost[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in cost]:
            i = min(pairs)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    r = random.Random(3)
    for _ in range(1000):
        part = "▁" + "".join(r.choice("aeinrst") for _ in range(r.randrange(20)))
        assert pieces.merged(part) == slow(part)
        assert pieces._rows([part, part + "日é\x00", "▁"])[0] == b"".join(pieces.symbols[s] for s in slow(part))


class Asked:
    """The library; notes the texts that it encodes, and gives other ids for those with a word of changed."""

    def __init__(self, library, changed=()):
        self.library, self.texts, self.changed = library, [], changed

    def encode(self, texts, **how):
        if isinstance(texts, str):
            return self.encode([texts], **how)[0]
        self.texts += texts
        return [i[:-1] if set(t.split(" ")).intersection(self.changed) else i for t, i in zip(texts, self.library.encode(texts, **how), strict=True)]


def new_words(n, seed):
    r = random.Random(seed)
    return list({"".join(r.choice("aeinrsté日.,\n") for _ in range(r.randrange(1, 14))) for _ in range(n)})


def test_new_words_of_a_group_are_not_handled_one_by_one(monkeypatch):
    pieces = sentence_pieces.MergePieces(PATH)
    words, cuts, cut = new_words(3000, 5), [], pieces.cut
    asked = Asked(pieces.library)
    monkeypatch.setattr(pieces, "library", asked)
    monkeypatch.setattr(pieces, "cut", lambda x: cuts.append(x) or cut(x))
    texts = [" ".join(words[x : x + 300]) for x in range(0, len(words), 300)] * 2
    ids, agrees = pieces.encode_batch(texts)
    assert all(agrees) and len(asked.texts) <= len(words) // 50 and len(cuts) < len(words) // 50
    want = asked.library.encode(texts, add_bos=True, add_eos=True)
    assert ids.to_pylist() == [array("I", i).tobytes() for i in want]
    asked.texts.clear()
    assert pieces.encode_batch(texts)[0].equals(ids) and not asked.texts


def test_texts_with_a_word_that_the_library_encodes_otherwise_do_not_agree(monkeypatch):
    pieces = sentence_pieces.MergePieces(PATH)
    words = new_words(1000, 6)
    monkeypatch.setattr(pieces, "library", Asked(pieces.library, {words[7], words[500]}))
    texts = [*(" ".join(words[x : x + 100]) for x in range(0, len(words), 100)), "", "  a b"]
    for _ in range(2):
        assert pieces.encode_batch(texts)[1] == [x not in (0, 5) for x in range(len(texts))]


def test_a_batch_of_any_ids_decodes_as_the_library_does(pieces):
    r, some = random.Random(7), [0, 1, 2, 259, 28705, *(3 + b for b in (0xE3, 0x81, 0x82, 0xF0, 0x9F, 0xED, 0xA0))]
    ids = [[r.choice([*some, r.randrange(32000)]) for _ in range(r.randrange(9))] for _ in range(2000)]
    ids += [[1, *x, 2] for x in ids] + [[1], [2], [1, 2], [1, 28705, 2]]
    want = [pieces.library.decode(x) for x in ids]
    assert pieces.decode_batch([sentence_pieces.as_ids(array("I", x).tobytes()) for x in ids]) == want and pieces.decode_batch([]) == []


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    for change in ("unigram", "unused", "bytes", "prefix"):
        m = pb.ModelProto.FromString(open(PATH, "rb").read())
        if change == "unigram":
            m.trainer_spec.model_type = 1
        elif change == "unused":
            m.pieces[500].type = 5
        elif change == "bytes":
            m.pieces[10].type = 1
        else:
            m.normalizer_spec.remove_extra_whitespaces = True
        (tmp_path / change).write_bytes(m.SerializeToString())
        with pytest.raises(ValueError, match="vocabular|models"):
            sentence_pieces.MergePieces(str(tmp_path / change))


SCHEMA = "doc_id long, text string, n_tokens string, runs int, agrees string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    texts = [*ODD, None, base_text(1), base_text(1), base_text(2, 5000), *[base_text(i, 60) for i in range(3, 200)]]
    texts += [" ".join(r.choice("ab c".split()) for _ in range(r.randrange(60))) for _ in range(100)] + ["a " * 300, "x y " * 99 + "x"]
    rows = [(i, t, "s", 1, None) for i, t in enumerate(texts)] + [(1, texts[1], None, None, None), (None, "a b a b a b a b a", None, 1, None), (-5, "q q q q q q", None, 1, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    return d


def test_op11(spark, docs, folder, pieces):
    got = sentence_pieces.op11_sentence_pieces(spark, folder).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = pieces.library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest(), True] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_pieces_without_the_check_and_of_no_rows(spark, docs):
    rows = sentence_pieces.decode(sentence_pieces.encode(docs.limit(5), PATH, check=False), PATH, check=False).collect()
    assert len(rows) == 5 and all(r["agrees"] is None for r in rows)
    assert sentence_pieces.encode(docs.limit(0), PATH).count() == 0


# ---- 12


def runs_by_hand(words, least_words=6, least_periods=4):
    """Stretches in which words q apart are equal, for every q that is their smallest."""
    n, out = len(words), []
    for q in range(1, n):
        k = 0
        while k + q < n:
            s = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            size, part = k - s + q, words[s : k + q]
            if k > s and size >= max(least_words, least_periods * q) and all(part[p:] != part[:-p] for p in range(1, q)):
                out.append((s, size, q))
            k += k == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_all_found():
    r = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(r.randrange(1, 4)):
            words = []
            while len(words) < r.choice([0, 5, 12, 40, 70]):
                words += ([b"%d" % r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(1, 7))] * r.randrange(1, 8))[: r.randrange(1, 40)]
            texts.append(words)
        for least in ((6, 4), (2, 2), (1, 3), (9, 2)):
            assert periodic_runs.runs_of(texts, *least) == [runs_by_hand(t, *least) for t in texts]


def test_runs_of_very_long_texts():
    n = 50_000
    assert periodic_runs.runs_of([[b"a"] * n, [b"a", b"b"] * (n // 2), [b"%d" % i for i in range(n)]]) == [[(0, n, 1)], [(0, n, 2)], []]


def test_op12(spark, docs, folder):
    got = {(r["doc_id"], r["runs_sha256"], r["collapsed_sha256"]): r for r in periodic_runs.op12_periodic_runs(spark, folder).collect()}
    sha = lambda s: hashlib.sha256(s).hexdigest()
    rows = docs.collect()
    planted = 0
    for row in rows:
        words = (row["text"] or "").encode().split()
        assert words == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")]
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        if row["doc_id"] is not None and h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_by_hand(words) if n < 1000 else periodic_runs.runs_of([words])[0]
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        key = row["doc_id"], sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop))
        r = got[key]
        assert r["n_runs"] == len(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if runs else None)
    assert planted > 10 and len({(r["doc_id"], r["text"]) for r in rows}) == len(got)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


# ---- 13

ROLES = ["system", "user", "assistant", "user", "assistant", "tool", ""]


def cheapest(rows):
    """(cost, audit) of (role, removed, cut) by search from the end."""

    @cache
    def f(i, state, inserts):
        ways = []
        if inserts < 3:
            to = "a" if state == "u" else "u"
            ways.append((2, "I", f(i, to, inserts + 1)))
        if i == len(rows):
            return min([(c + w[0], e + w[1]) for c, e, w in ways if w] + ([(0, "")] if state in ("", "a") else []), default=None)
        role, removed, cut = rows[i]
        ways.append((3, "D", f(i + 1, state, 0)))
        for edit, cost, to in () if removed else (("K", 0, role[:1]), ("R", 2, "u"), ("R", 2, "a")):
            if (to == "s" and edit == "K" and state == "") or (to == "u" and state != "u") or (to == "a" and state == "u"):
                ways.append((cost + cut, edit, f(i + 1, to, 0)))
        return min(((c + w[0], e + w[1]) for c, e, w in ways if w), default=None)

    return f(0, "", 0)


@pytest.mark.parametrize("held", [0, 10, 1 << 20])
def test_repair_is_the_cheapest_and_the_least(held):
    r = random.Random(6)
    for _ in range(4000):
        rows = [(r.choice(ROLES), r.random() < 0.25, r.random() < 0.3) for _ in range(r.randrange(12))]
        out = []
        s = repair.Search(lambda *e: out.append(e), held)
        for i, (role, removed, cut) in enumerate(rows):
            s.row(role, f"text{i}é", removed, cut)
        cost = s.end()
        assert (cost, "".join(e for e, _, _ in out)) == cheapest(tuple(rows))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in out if role))
        at = [i for i, e in enumerate(x for x in (e for e, _, _ in out) if x != "I") if e != "D"]
        assert [t for e, _, t in out if e in "KR"] == [f"text{i}é" for i in at]


def test_what_is_settled_is_handed_on():
    r = random.Random(7)
    for kind in ("fine", "blank", "mixed"):
        done, most = [0], 0

        def count(*_, done=done):
            done[0] += 1

        s = repair.Search(count)
        for i in range(20_000):
            s.row(("user", "assistant")[i % 2] if kind != "mixed" else r.choice(ROLES), "x", kind == "blank" and i > 1, False)
            most = max(most, s.open_rows())
        s.end()
        assert done[0] >= 20_000 and most < 200, kind


def by_hand(rows):
    """The contract's row of one conversation, its rows after damage in order: turn, role, text."""
    turns = [t for t, _, _ in rows if t is not None]
    out = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0}
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        if fault:
            out[fault] += 1
    out["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    out["cost"], out["audit"] = cheapest(tuple(faults))
    said, state, i = [], "", 0
    for e in out["audit"]:
        to = "assistant" if state == "u" else "user"
        role, text = (to, "") if e == "I" else rows[i][1:]
        i += e != "I"
        if e != "D":
            role = to if e == "R" else role
            state = role[0]
            said.append(f"{role}:{text}")
    return out | {"repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest()}


def test_op13(spark, tmp_path):
    r = random.Random(8)
    rows = [(c, t if r.random() < 0.9 else t + 3, r.choice(ROLES), r.choice(["Yes.", "no", "Why? ", " \t", "a. b", base_text(c % 5, 8)]), "x") for c in range(150) for t in range(r.randrange(1, 9))]
    rows += [(1, None, "user", "Yes.", None), (1, None, None, None, None), (None, 3, "user", "Hm.", None), (None, 4, "assistant", "Hm.", None), (2, 0, "user", "Yes.", None), (2, 0, "user", "Yes.", None), (7, 10**12, "assistant", None, None)]
    rows += [(900, t, ("user", "assistant")[t % 2], f"line {t % 50}.", None) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        hurt[c] += []
        if way:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(way, text)
            hurt[c] += [(t, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    got = {x["conv_id"]: x.asDict() for x in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == set(hurt)
    for c, of in hurt.items():
        of.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        if c == 900:  # too deep for the search by hand
            assert got[c]["duplicate"] > 2500 and len(got[c]["audit"]) >= len(of)
            continue
        assert got[c] == {"conv_id": c} | by_hand(of), (c, of)


def test_edits_are_rows_and_no_rows_give_none(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well"), (2, 0, "tool", " ")], "conv_id long, turn long, role string, text string")
    rows = [tuple(x) for x in repair.edits(df).orderBy("conv_id", "place").collect()]
    assert rows == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Well"), (2, 0, "D", None, None)]
    assert repair.summaries(df.limit(0)).count() == 0
