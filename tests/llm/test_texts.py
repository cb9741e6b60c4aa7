"""Token ids, leaks, sentences and broken pairs."""

from __future__ import annotations

import random
import re
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import defects as D
from rillstone.llm import leaks as L
from rillstone.llm import sentences as S
from rillstone.llm.plans import TOKENIZERS
from rillstone.llm.tokens import decode_ids, encode_texts, read_ranks

HARD = [
    "", None, " ", "a", "  two  spaces \n\n x", "It's we'll I'D they've", "naïve café — “q”…", "数据流 パイプライン 데이터", "ไทยและहिन्दी العربية", "👩‍💻🚀 ‍x", "<|endoftext|> <s>", " ​　  tail ",
    "x" * 700, "ab" * 400 + "\n", "1234567 12,34.5 ¹²", "\t\r\n\v\f\x85end", "İıſ ǅ ẞ", "áè", "𝔘𝔫𝔦 𐍈", "==== ---- ////", "don't'd's",
]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_ids_equal_the_public_tokenizer(spark, ranks):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    rows = [(i, t, "x") for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id int, text string, word string")
    out = encode_texts(df, "doc_id", "text", ranks)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert out.count() == len(HARD) + 5
    assert {r["doc_id"]: r["ids"] for r in encode_texts(df, "doc_id", "text", ranks, chunk=64).collect()} == got
    for i, t in enumerate(HARD):
        assert got[i] == (tk.encode(t, add_special_tokens=False).ids if t else []), repr(t)
    back = {r["doc_id"]: r["text"] for r in decode_ids(out, "doc_id", "ids", ranks).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(HARD))


def test_ids_edges(spark, ranks):
    df = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "b"), (1, None)], "k int, t string")
    assert sorted((str(r["k"]), len(r["ids"])) for r in encode_texts(df, "k", "t", ranks).collect()) == [("1", 0), ("1", 1), ("1", 1), ("None", 2)]
    assert encode_texts(df.limit(0), "k", "t", ranks).count() == 0


def test_long_words(spark, ranks):
    """Runs that no cut divides: as the public tokenizer has them, and not slower than in proportion to their length."""
    import tiktoken

    public = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "a", "xyyyy") for n in (33, 64, 65, 700, 3_000)]
    texts += ["не" * 200, "ताा" * 150, "จะะ" * 120]
    out = encode_texts(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", ranks)
    got = {r["i"]: r["ids"] for r in out.collect()}
    for i, t in enumerate(texts):
        if t.isascii():
            assert got[i] == public.encode_ordinary(t), t[:40]
    assert all(r["text"] == texts[r["i"]] for r in decode_ids(out, "i", "ids", ranks).collect())
    times = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([(0, "".join(rng.choice("etaoinshrdlu") for _ in range(n)))], "i int, t string")
        began = time.time()
        assert len(encode_texts(df, "i", "t", ranks).collect()[0]["ids"]) > n / 8
        times.append(time.time() - began)
    assert times[1] < 8 * times[0]


ITEM = "Suppose that Ophbal runs 902 copies of rath.dor() on the Ophvor cluster and that the monotone minibatch of copy 504,458 validates its session window when Dixolasha deletes 30 keys behind ner_ner_21."
OTHER = "Suppose that Tastas runs 73 copies of mursha.py on the Ulequa cluster and that the bounded tumbling window of copy 42 rewrites its license check if Eldqua finds a null beside silurs_32."
THIRD = "Suppose that Melwex runs 12 copies of gan.tal on the Britov cluster and that the sparse primary key of copy 7 splits its latency probe until Hesklom confirms offset 5 in writing."
ZH = "假设珞璟工厂在珞筠集群上运行536,570个fen_nev_17副本，并且连接器会在19.233秒之后丢弃过期的向量，当峤霁向urs.tri报告了7140处缺口时。"


def found(spark, docs, items=(ITEM, OTHER, THIRD, ZH), **kw):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").withColumn("n", F.lit(1))
    q = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    return {(r["doc_id"], r["item_id"]) for r in L.leaked(d, "doc_id", "text", q, "item_id", "text", **kw).collect()}


def test_leaks(spark):
    words = ITEM.split()
    replaced = [("usual" if i % 7 == 3 else w) for i, w in enumerate(words)]
    docs = [
        "Before. " + ITEM + " After.", "x " + " ".join(words[5:21]) + " y", ITEM.upper(), "**" + "**  ".join(words) + "\n", " ".join(replaced), "".join(c + ("​" if i % 9 == 0 else "") for i, c in enumerate(ITEM)),
        " ".join(words[5:17]), "Suppose that Nerbal runs 44 copies of x.py on the Quator cluster and that the cold cache of copy 9 drops its window.", None, "", "word", ZH[:60], ZH[3:20], "前" + ZH.replace("，", ", "),
    ]
    assert found(spark, docs) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (11, 3), (13, 3)}


def test_leaks_in_blocks_and_copies(spark):
    """Blocks of one item find the same; a passage in most documents is found in all of them."""
    docs = [ITEM] * 30 + [OTHER, THIRD, "nothing"]
    want = {(i, 0) for i in range(30)} | {(30, 1), (31, 2)}
    assert found(spark, docs) == want and found(spark, docs, block=1) == want
    assert found(spark, docs, items=()) == set() and found(spark, [], items=(ITEM,)) == set()


def test_leaks_that_many_items_hold(spark):
    """A passage that several items share, and the same item under several ids, are found for all of them."""
    shared = "When the quartz feeder behind the northern relay stops counting its blue tickets before noon the oldest warden copies every ledger to the spare drum."
    asked = [f"{shared} {end}" for end in ("Who copies the ledger?", "What stops before noon?", "Which drum is spare?", "Where does the feeder stand?")]
    items = [*asked, ITEM, ITEM, ITEM, OTHER]
    docs = ["Before. " + shared + " After.", "x " + ITEM.lower(), asked[1]]
    want = {(0, i) for i in range(4)} | {(1, i) for i in (4, 5, 6)} | {(2, i) for i in range(4)}
    assert found(spark, docs, items) == want and found(spark, docs, items, block=1) == want


def test_leaks_of_one_template_are_told_apart(spark):
    """Of items that differ in a name and a number, only the one that is reproduced is found, whatever the blocks."""
    line = "In the notebook of {} it is written that the buffer sorts {} pages while the feeder still counts its blue tickets"
    items = [line.format(f"Name{i}", 100 + i) for i in range(6)]
    docs = ["x " + items[2] + " y", items[4] + " and " + items[1]]
    want = {(0, 2), (1, 4), (1, 1)}
    assert found(spark, docs, items) == want and found(spark, docs, items, block=2) == want


@pytest.mark.parametrize("held", [1, 5, 10])
def test_a_passage_under_many_ids(spark, held):
    """One passage under several item ids is found under all of them, copied whole or in a very long document that repeats its seeds."""
    long = "in written note: " + " ".join("the Ophvor cluster and that x" for _ in range(3_000))
    want = {(0, i) for i in range(held)} | {(1, i) for i in range(held)}
    assert found(spark, ["Before. " + ITEM + " After.", long + " " + ITEM + " " + long, long], [ITEM] * held + [OTHER]) == want


def test_tokens_fold_typography():
    assert L.tokens("<b>Ｎaïve</b>&nbsp;“CAFÉ”…\u200b раth 数据 don’t") == ["naive", "cafe", "path", "数", "据", "dont"]


def test_alignment_by_brute_force():
    rng = np.random.default_rng(0)
    r = L.Passages()
    for _ in range(30):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 15)
        h = np.zeros((13, 16))
        for i in range(1, 13):
            for j in range(1, 16):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -r.mismatch), h[i - 1, j] - r.gap, h[i, j - 1] - r.gap)
        first, last, m = L.align(a, b, r)
        assert len(m) <= last - first and (h.max() == 0) == (first == last)
        assert h.max() <= len(m)


TEXTS = [
    'No. 42 on the list is Dr. Kim\'s, i.e. ours, since v2.3.1 costs 3.5 ms. vor.zan returns it. "Why is it so?" asked Gosnev, who left. He wrote: "It works." Use p.m. times etc. The end',
    "Man nutzt z. B. mel.nev, d. h. am 3. Mai ca. 44 Zeilen. „Halt!“, rief Tas. Siehe Nr.\n9072. Ende.",
    "On emploie p. ex. ola.lom() ici. «\xa0Non\xa0!\xa0» répond Vor. Fin\xa0!",
    "¿Por qué? ¡No toque nada! Según el Sr. Bal, sí.",
    "Здесь берут mur.nev(), т. е. буфер (см. рис. 45). «Да!» — сказал Ner. Всё.",
    "“为什么要移动？”衡岫一边看一边问。“好。”他说。比例从1.5升到2……因为慢。霁岚说：“必须走！”结束了吗？是。",
    "棠璟は「破棄する。」と書き残した。なぜ？終わり！",
    "नियोजक गिनता है। क्या यह सही है? हाँ।",
    "يقول د. Len إن هذا صحيح. لماذا؟ نعم!",
    "อย่าแตะหากไม่มี ola_pra อยู่ในระบบ ทำไมตัวอ่านจึงเรียง รุ่น v0.28.3 ทำให้เร็วขึ้น",
]
UNITS = [
    ["No. 42 on the list is Dr. Kim's, i.e. ours, since v2.3.1 costs 3.5 ms.", "vor.zan returns it.", '"Why is it so?" asked Gosnev, who left.', 'He wrote: "It works."', "Use p.m. times etc.", "The end"],
    ["Man nutzt z. B. mel.nev, d. h. am 3. Mai ca. 44 Zeilen.", "„Halt!“, rief Tas.", "Siehe Nr.\n9072.", "Ende."],
    ["On emploie p. ex. ola.lom() ici.", "«\xa0Non\xa0!\xa0» répond Vor.", "Fin\xa0!"],
    ["¿Por qué?", "¡No toque nada!", "Según el Sr. Bal, sí."],
    ["Здесь берут mur.nev(), т. е. буфер (см. рис. 45).", "«Да!» — сказал Ner.", "Всё."],
    ["“为什么要移动？”衡岫一边看一边问。", "“好。”他说。", "比例从1.5升到2……因为慢。", "霁岚说：“必须走！”", "结束了吗？", "是。"],
    ["棠璟は「破棄する。」と書き残した。", "なぜ？", "終わり！"],
    ["नियोजक गिनता है।", "क्या यह सही है?", "हाँ।"],
    ["يقول د. Len إن هذا صحيح.", "لماذا؟", "نعم!"],
    ["อย่าแตะหากไม่มี ola_pra อยู่ในระบบ", "ทำไมตัวอ่านจึงเรียง", "รุ่น v0.28.3 ทำให้เร็วขึ้น"],
]


@pytest.fixture(scope="module")
def tagger(spark):
    return S.trained(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "text")


def test_sentences(tagger):
    for t, want in zip(TEXTS, UNITS, strict=True):
        assert [t[a:b] for a, b in tagger.units(t)] == want


def test_structure(tagger):
    t = "## A title. Two\n\n- item. One\n- item two\n\n| a. | b |\n| c | d |\r\n\r\n```\nx = 1. Y\n\nz\n```\n2039-01-18 12:45:07,498 WARN a. B\n \t\nchecksum ab12cd34ef56\n\nLine one\rgoes on. New​\n \n"
    assert [t[a:b] for a, b in tagger.units(t)] == ["## A title. Two", "- item. One", "- item two", "| a. | b |", "| c | d |", "```\nx = 1. Y\n\nz\n```", "2039-01-18 12:45:07,498 WARN a. B", "checksum ab12cd34ef56", "Line one\rgoes on.", "New​"]


def test_sentence_edges(spark, tagger):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (4, "word"), (None, "So it is. Go on."), (5, "So it is. " * 30_000)], "doc_id int, text string").withColumn("t", F.lit("clash"))
    out = S.sentence_units(df, "doc_id", "text", tagger)
    n = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {4: 1, None: 2, 5: 30_000}
    assert S.sentence_units(df.limit(0), "doc_id", "text", tagger).count() == 0


@pytest.fixture(scope="module")
def halves(spark):
    """The texts of sf0.1 in two parts, by hash."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").select("text", F.pmod(F.xxhash64("text"), F.lit(4)).alias("part"))
    rows = [(r["text"], r["part"]) for r in df.distinct().collect()]
    return sorted(t for t, p in rows if p == 1), [t for t, p in rows if p != 1]


def test_labels_come_from_the_layout():
    """No list of abbreviations: what only stands inside paragraphs is learnt from where paragraphs end."""
    rng = random.Random(3)
    nouns = "boat crew paint shed rain noon rope sail lamp dock wave wind".split()

    def sentence() -> str:
        a, b = rng.choice(nouns), rng.choice(nouns)
        return f"The {a} of Zorb. {b.title()} is near the {rng.choice(nouns)}." if rng.random() < 0.4 else f"{a.title()} and {b} are near the {rng.choice(nouns)}."

    many = [[sentence() for _ in range(rng.randint(1, 4))] for _ in range(300)]
    tg = S.Tagger.train(["\n\n".join(" ".join(p) for p in many[i : i + 3]) for i in range(0, 200)])
    for p in many[200:]:
        assert len(tg.units(" ".join(p))) == len(p)


def test_held_out_text_without_marks(halves):
    """Texts that were not trained on, without their marks and spaces: the chains of characters find the boundaries again, and leave text with marks alone."""
    own, others = halves
    tg = S.Tagger.train(own[:2000], bare_texts=[t for t in own if S._UNBARE.search(t)])
    for script, letter in S._LETTER.items():
        good = told = true = extra = units = runs = 0
        for t in others[:6000]:
            for s, e, whole in S.blocks(t):
                p = t[s:e].strip()
                if whole or 2 * len(letter.findall(p)) < len(p):
                    continue
                ends = tg.marked.ends(p, 0, len(p))
                run, _, tags = S.stripped(p, ends, script, [False] * len(ends))
                cuts, want = {b for _, b in tg.units(run)[:-1]}, set((np.flatnonzero(tags) + 1).tolist())
                good, told, true = good + len(cuts & want), told + len(cuts), true + len(want)
                extra, units, runs = extra + len({b for _, b in tg.units(p)} - set(ends)), units + len(ends), runs + (0 < len(want) and len(run) < 100)
        assert true > 300 and runs > 15 and good / true > 0.93 and good / told > 0.9, (script, good, told, true)
        assert extra < 0.005 * units


SOUND = [
    ("How many rows did a.py read?", "During that run a.py read 53 rows from the sliding window.", ["During that run a.py read 53 rows from the sliding window."]),
    ("How many rows did a.py read?", "53", ["x"]), ("Which file configures it?", "ner_21.yaml", []), ("Is it kept?", "Yes.", []), ("Which German word is used for a late row?", "Nachzügler", ["x"]),
    ("Can it work?", "I'm afraid of one case only (the late row); otherwise the backfill of Tas samples rows without any watermark.", []),
    ("List the steps.", "First the window flushes the index; second, a.py caches the row; third, Tas restarts the worker on port 43", ["y"]),
    ("Combien de temps dure la pause ?", "38.979 secondes", []), ("在峤项目中，读取器的作用是什么？", "在峤项目中，读取器负责压缩声明的模式，其余的数据由gos.zan在窗口关闭之后处理。", []),
]


def test_pairs_broken_on_purpose():
    """Sound pairs, and the same broken in each way: precision and recall of the votes with the label model."""
    rows = [(q, a, c, "") for q, a, c in SOUND] * 30
    long_ones = [(q, a, c) for q, a, c in SOUND if len(a) > 50 and not a.endswith("43")]
    for q, a, c in long_ones:
        rows += [(q, a[: int(len(a) * 0.6)].rstrip("。."), [*c, a], "truncated")] * 2
    for q, _, c in SOUND:
        rows += [(q, x, c, "empty") for x in (None, "", " \n", "N/A", "—", "​", "null")]
        rows += [(q, x, c, "copies_question") for x in (q, q.upper(), f'"{q}"', f"{q} {q}", "Question: " + q)]
        rows += [(q, x, c, "refusal") for x in ("I'm sorry, but I can't help with that request.", "As an AI language model, I do not have access to that.", "Je suis désolé, mais je ne peux pas répondre.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "很抱歉，我无法回答这个问题。", "Мне нельзя давать сведения об этом.")]
    rows += [(SOUND[0][0], x, ["z"], "other_language") for x in ("Der Abschluss scheitert, weil der Index noch auf die Zeilen wartet.", "La validation échoue parce que le journal attend encore les lignes.", "Фиксация не проходит, потому что индекс ещё ждёт.", "提交失败的原因是索引服务仍在等待回复。")] * 3
    v = np.array([D.votes(q, a, c) for q, a, c, _ in rows])
    at, told = 0, [set() for _ in rows]
    for d, fs in D.FUNCTIONS.items():
        pats, inv, n = np.unique(v[:, at : at + len(fs)], axis=0, return_inverse=True, return_counts=True)
        post = D.label_model(pats, n)[inv.ravel()]
        at += len(fs)
        for i in np.flatnonzero(post > D.CUTOFFS[d]):
            told[i].add(d)
    # another language's refusal is a refusal first
    wrong = [(r, t) for r, t in zip(rows, told, strict=True) if (r[3] not in t if r[3] else bool(t))]
    assert len(wrong) <= 0.02 * len(rows), wrong[:5]


def test_defects_edges(spark):
    df = spark.createDataFrame([(1, "q", None, None), (2, None, "fine.", [None]), (3, None, None, []), (3, None, None, [])], "pair_id int, question string, reference string, c array<string>").withColumn("votes", F.lit(1))
    out = D.defects(df, "pair_id", "question", "reference", "c")
    assert {(r["pair_id"], r["defect"]) for r in D.main_defect(out).collect()} == {(1, "empty"), (3, "empty")} and out.count() == 2
    assert D.defects(df.limit(0), "pair_id", "question", "reference", "c").count() == 0


def test_nothing_else_imports_this_package():
    assert "rillstone.llm" in sys.modules
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "rillstone"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]
