"""Broken prompt and response pairs: noisy labelling functions, combined by an expectation-maximization label model."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, written

DEFECTS = ("empty", "truncated", "refusal", "copies_question", "other_language")
#: Posterior above which a pair has a defect, chosen on pairs that were broken on purpose (tests).
CUTOFFS = {"empty": 0.5, "truncated": 0.3, "refusal": 0.5, "copies_question": 0.5, "other_language": 0.5}

# Filler, phrases and function words.
_FILLER = frozenset("null none nil nan na n/a undefined unknown tbd todo empty blank keine ninguno aucun нет 无 なし".split())
_END = re.compile(r"[.!?。！？．…।؟][\s\"'”’»)）」』\]*_`]*$")
_OPEN_END = re.compile(
    r"(?:[,;:、，；—–-]|\b(?:the|a|an|of|to|in|and|or|is|by|for|with|from|that|which|than|on|at|as|der|die|das|den|dem|ein|eine|und|oder|zu|mit|von|auf|le|la|les|un|une|de|des|du|et|ou|que|à|el|los|las|una|y|o|en|por|con|para|и|или|в|на|с|что|из|к|по))$",
    re.I,
)
_REFUSAL = re.compile(
    r"""\b(?:
      (?:i(?:'|’)?m|i\ am|we\ are|we(?:'|’)?re)\ (?:sorry|afraid\ (?:that\ )?i|unable|not\ (?:able|allowed|permitted|comfortable|at\ liberty|in\ a\ position))
    | i\ (?:can(?:no|'|’)t|cannot|can\ not|won(?:'|’)t|will\ not|must\ decline|have\ to\ decline|decline|do\ not\ have\ access|don(?:'|’)t\ (?:have\ (?:access|enough)|feel\ comfortable|know\ how)|am\ unable|refuse|would\ rather\ not|prefer\ not|(?:do\ not|don(?:'|’)t)\ wish)
    | as\ an?\ (?:\w+\ )?(?:ai|language\ model|assistant|artificial)
    | (?:guidelines|policy|policies|instructions|rules)\ (?:keep|prevent|do\ not\ allow|don(?:'|’)t\ allow|forbid|prohibit|stop)
    | outside\ (?:of\ )?what\ i(?:(?:'|’)m|\ am)
    | (?:isn(?:'|’)t|is\ not|not)\ (?:something\ i|enough\ information\ (?:for\ me|to\ answer))
    | something\ i\ (?:won(?:'|’)t|can(?:'|’)t|cannot|can\ not|will\ not)
    | unfortunately,?\ i\b | must\ (?:respectfully\ )?decline | not\ comfortable\ (?:answering|with)
    | es\ tut\ mir\ leid | tut\ mir\ leid | (?:darf|kann|möchte|werde)\ ich\ (?:\w+\ ){0,4}(?:nicht|keine) | ich\ (?:kann|darf|möchte|werde)\ (?:\w+\ ){0,6}(?:nicht|keine)(?:\ |$) | (?:frage|darauf|dazu)\ (?:\w+\ ){0,3}(?:möchte|kann|darf|will|werde)\ ich
    | als\ (?:ki\b|sprachmodell|künstliche) | keine\ auskunft
    | je\ (?:suis\ désolé|regrette|ne\ (?:peux|puis|suis\ pas\ (?:en\ mesure|autoris|habilit)|souhaite)|préfère\ ne\ pas|refuse|dois\ (?:décliner|refuser)) | désolée?,\ (?:mais\ )?je | il\ m(?:'|’)est\ (?:impossible|interdit) | en\ tant\ (?:que|qu(?:'|’))\ ?(?:modèle|ia|intelligence|assistant)
    | lo\ siento | (?:no\ puedo|no\ me\ es\ posible|no\ estoy\ (?:autorizad|en\ condiciones)|no\ me\ está\ permitido|no\ se\ me\ permite|prefiero\ no|me\ niego) | como\ (?:modelo|ia\b|inteligencia|asistente)
    | к\ сожалению,?\ (?:я|мне) | (?:извините|простите),?\ (?:но\ )?(?:я|мне) | мне\ (?:нельзя|запрещено|не\ разрешено|не\ позволено) | я\ (?:не\ (?:могу|имею\ права|вправе|стану|буду)|предпочту\ не|предпочитаю\ не|вынужден|отказываюсь|воздержусь) | как\ (?:языковая\ модель|ии\b|искусственный)
    )""",
    re.I | re.X,
)
_REFUSAL_CJK = re.compile(
    r"抱歉|对不起|不便(?:回答|透露|提供)|无法(?:回答|提供|回复|透露|协助|帮助)|不能(?:回答|提供|透露|协助|帮助)|不方便(?:回答|透露)|拒绝回答|作为(?:一个)?(?:语言|人工智能|ai)|不予(?:回答|置评)"
    r"|申し訳(?:ありません|ございません)|お答え(?:できません|しかねます|いたしかねます|は控え)|回答(?:できません|は控え|を控え|しかねます)|提供(?:できません|しかねます)|お(?:手伝い|話し)(?:できません|することはできません)|(?:言語モデル|ai)として|控えさせて"
)
_WORDS = {
    "en": "the of and to in is it that for on with as by what does how which when why during until because no yes not are from first rest only each who this be can cannot steps",
    "de": "der die das den dem des und ist im in zu mit von auf nicht wie was warum welche wird hat noch weil wenn dass aus bei bis insgesamt sekunden zeilen gilt man danach sobald obwohl",
    "fr": "le la les l des du de et est dans que qui pour pas une un sur combien pourquoi au par en a lu cette secondes lignes parce sans afin lorsque bien encore projet pendant après",
    "es": "el la los las de y es en que por para una un con no cómo cuántas cuánto qué del al lo se leyó segundos filas porque sin todavía después durante mientras antes proyecto cuando",
}
_BY_WORD: dict[str, set[str]] = {}
for _lang, _list in _WORDS.items():
    for _w in _list.split():
        _BY_WORD.setdefault(_w, set()).add(_lang)
#: How questions name a language whose word they ask for.
_ASKED = re.compile(
    r"\b(?:german|french|spanish|english|russian|chinese|japanese|italian|latin|translat\w*|deutsch\w*|französisch\w*|spanisch\w*|englisch\w*|russisch\w*|chinesisch\w*|japanisch\w*|übersetz\w*|allemand\w*|français\w*|espagnol\w*|anglais\w*|russe|chinois\w*|japonais\w*|tradui\w*"
    r"|alem[aá]n\w*|franc[eé]s\w*|español\w*|ingl[eé]s\w*|ruso\w*|chin[oa]|japon[eé]s\w*|traduc\w*|немецк\w*|французск\w*|испанск\w*|английск\w*|китайск\w*|японск\w*|перев\w*)|英语|德语|法语|俄语|日语|西班牙语|翻译|英語|ドイツ語|フランス語|スペイン語|ロシア語|中国語|翻訳",
    re.I,
)
_HAN, _KANA, _CYR, _LAT = re.compile("[一-鿿㐀-䶿]"), re.compile("[぀-ヿ]"), re.compile("[а-яё]", re.I), re.compile("[a-zà-öø-ÿœßẞ]", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Za-z0-9_./()-]*[\d_./()][A-Za-z0-9_./()-]*|`[^`]*`")
_LEAD = frozenset("question frage pregunta вопрос 问 题 問 質 q prompt query you asked i was".split())


def plain(s: str | None) -> str:
    """Text in composed form, without invisible characters, white space in single blanks."""
    s = unicodedata.normalize("NFKC", s or "")
    return " ".join("".join(c for c in s if unicodedata.category(c) not in ("Cf", "Cc") or c.isspace()).split())


def language(s: str) -> tuple[str, float]:
    """(language, strength) of a text by script and function words; names and code don't count. ('', 0) if it can't be told."""
    t = _NAME.sub(" ", s.replace("。", "。 ").replace("，", "， "))
    han, kana, cyr, lat = (len(p.findall(t)) for p in (_HAN, _KANA, _CYR, _LAT))
    if kana and kana + han >= 3 and 2 * (kana + han) >= lat / 3:
        return "ja", min(3.0, kana)
    if han >= 2 and 3 * han >= lat / 2:
        return "zh", min(3.0, han / 2)
    if cyr > 2 and 2 * cyr >= lat:
        return "ru", 3.0
    votes = dict.fromkeys(_WORDS, 0.0)
    for w in _WORD.findall(t.lower()):
        for lang in _BY_WORD.get(w, ()):
            votes[lang] += 1.0 / len(_BY_WORD[w])
    best = max(votes, key=votes.__getitem__)
    rest = max(v for k, v in votes.items() if k != best)
    return (best, votes[best] - rest) if votes[best] > rest else ("", 0.0)


def _units(s: str) -> list[str]:
    return re.findall(r"[぀-ヿ㐀-鿿]|[^\W_]+", plain(s).casefold())


def _length(s: str) -> float:
    """Length in words; two and a half Chinese or Japanese characters are a word."""
    cjk = len(_HAN.findall(s)) + len(_KANA.findall(s))
    return cjk / 2.5 + len(re.sub("[぀-ヿ㐀-鿿]", " ", s).split())


def votes(question: str | None, answer: str | None, contexts: list[str | None] | None) -> list[int]:
    """One vote per labelling function: 1 the defect, -1 not the defect, 0 no opinion."""
    q, a = plain(question), plain(answer)
    ctx = [plain(c) for c in contexts or [] if c]
    out = dict.fromkeys(NAMES, 0)

    def vote(name: str, defect: bool, sound: bool = False) -> None:
        out[name] = 1 if defect else -1 if sound else 0

    letters = any(c.isalnum() for c in a)
    bare = a.strip(" .,:;!?…-–—_*()[]{}<>\"'`").casefold()
    vote("empty_nothing", not letters, letters and bare not in _FILLER)
    vote("empty_filler", bare in _FILLER or not bare, bare not in _FILLER)
    if not letters or bare in _FILLER:
        return [out[n] for n in NAMES]

    size, ends = _length(a), bool(_END.search(a))
    whole = any(a == c or a.rstrip(".。!?！？") == c.rstrip(".。!?！？") for c in ctx)
    # a context goes on where the answer stops, and not with another sentence
    part = size >= 2.5 and not whole and any(c.startswith(a) and len(c) > len(a) + 1 and not (ends and (c[len(a)].isspace() or a[-1] in "。！？")) for c in ctx)
    lists = len(re.findall(r"\b(?:first|second|third|fourth|fifth|finally|zuerst|zweitens|drittens|premièrement|deuxièmement|troisièmement|primero|segundo|tercero|во-первых|во-вторых|в-третьих)\b|第[一二三四五]|[;；]|^\s*[-*•\d]", a, re.I))
    complete_list = lists >= 3 and not _OPEN_END.search(a) and bool(re.search(r"(?:third|drittens|troisièmement|tercero|в-третьих|第三|last|finally)[,，]?(?:\s*\S+){4}", a, re.I))
    qu, au = _units(q), _units(a)
    qs, new = set(qu), [u for u in au if u not in set(qu) and u not in _LEAD]
    covered = len(qs & set(au)) / max(1, len(qs))
    copied = bool(qu) and covered >= 0.8 and not new
    vote("cut_no_end", not ends and size >= 4 and not copied, (ends or size <= 3 or copied) and not part)
    vote("cut_part_of_context", part, whole)
    vote("cut_open_end", bool(_OPEN_END.search(a)) and size >= 2, ends)
    vote("cut_not_a_list", False, complete_list or whole)

    refuses = bool(_REFUSAL.search(a) or _REFUSAL_CJK.search(a))
    vote("refusal_phrase", refuses, not refuses)
    vote("refusal_start", bool(_REFUSAL.match(a[:40]) or _REFUSAL_CJK.search(a[:12])))
    qn, an = set(re.findall(r"\d[\d.,]*\d|\d", q)), set(re.findall(r"\d[\d.,]*\d|\d", a))
    vote("refusal_nothing_told", refuses and not (an - qn), bool(an - qn) or whole)
    vote("refusal_answers", False, whole or (size > 14 and bool(re.search(r"only|otherwise|;", a)) and not refuses))

    vote("copy_same", bool(qu) and (au == qu or au == qu * 2 or au == qu * 3), bool(new) and len(new) > 2)
    vote("copy_nothing_new", bool(au) and len(qu) > 1 and not new and covered >= 0.8, covered < 0.6 or len(new) > 3)
    vote("copy_asks", covered >= 0.8 and a.rstrip(" \"'”»」").endswith(("?", "？")), whole)

    lq, sq = language(q)
    la, sa = language(a)
    if not la or not lq:
        vote("lang_words", False, size <= 2)
    else:
        vote("lang_words", lq != la and sa >= 1, lq == la)
        latin = {"en", "de", "fr", "es"}
        vote("lang_script", lq != la and not (lq in latin and la in latin) and sa >= 1.5, lq == la)
        vote("lang_strong", lq != la and sa >= 2 and sq >= 1, lq == la)
    if whole:
        out["lang_context"] = -1 if lq == la or not la or not lq else 0
    asked = bool(_ASKED.search(q)) and size <= 4
    vote("lang_asked_for", False, asked)
    return [out[n] for n in NAMES]


#: Labelling functions by defect.
FUNCTIONS = {
    "empty": ("empty_nothing", "empty_filler"),
    "truncated": ("cut_no_end", "cut_part_of_context", "cut_open_end", "cut_not_a_list"),
    "refusal": ("refusal_phrase", "refusal_start", "refusal_nothing_told", "refusal_answers"),
    "copies_question": ("copy_same", "copy_nothing_new", "copy_asks"),
    "other_language": ("lang_words", "lang_script", "lang_strong", "lang_context", "lang_asked_for"),
}
NAMES = tuple(n for fs in FUNCTIONS.values() for n in fs)


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.03, strength: float = 0.02) -> np.ndarray:
    """Posterior of the defect for every vote pattern, by expectation-maximization.

    patterns: one row per distinct pattern of votes in {-1, 0, 1}; counts: how
    many pairs have it. The model: the defect is latent, and given it every
    labelling function that has an opinion is right with a probability of its
    own, one for the defect and one for its absence. They start at 0.9 and stay
    between 0.6 and 0.995 (a function that is worse than chance is no labelling
    function); ``strength`` times the number of pairs are the pseudo-counts of
    that start. Abstaining tells nothing, so that groups which merely silence
    the same functions are not taken for a defect.
    """
    votes, n = patterns.astype(int), counts.astype(float)
    yes, no = (votes == 1).astype(float), (votes == -1).astype(float)
    right = np.full((2, votes.shape[1]), 0.9)  # of the sound, of the defective
    pi, post, pseudo = prior, np.zeros(len(votes)), max(10.0, strength * n.sum())
    for _ in range(rounds):
        odds = np.log(pi / (1 - pi)) + yes @ np.log(right[1] / (1 - right[0])) + no @ np.log((1 - right[1]) / right[0])
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        d, s = n * post, n * (1 - post)
        right[1] = (d @ yes + 0.9 * pseudo * prior) / (d @ (yes + no) + pseudo * prior)
        right[0] = (s @ no + 0.9 * pseudo) / (s @ (yes + no) + pseudo)
        right = np.clip(right, 0.6, 0.995)
        pi = float(np.clip((d.sum() + 20 * prior) / (n.sum() + 20), 1e-4, 0.3))
    return post


def pair_votes(pairs: DataFrame, pair_id: str, question: str, answer: str, contexts: str) -> DataFrame:
    """``pair_id`` and ``votes`` array<tinyint>, in the order of ``NAMES``."""
    rows = pairs.select(F.col(pair_id).alias("pair_id"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a"), F.col(contexts).cast("array<string>").alias("c"))
    rows, kind = spread(rows, pairs), rows.schema["pair_id"].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [votes(q, a, c) for q, a, c in zip(*(b.column(k).to_pylist() for k in "qac"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("pair_id"), pa.array(found, pa.list_(pa.int8()))], names=["pair_id", "votes"])

    return rows.mapInArrow(over, f"pair_id {kind}, votes array<tinyint>")


def defects(pairs: DataFrame, pair_id: str, question: str, answer: str, contexts: str, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """``pair_id``, ``defect``, ``posterior``: every defect of every pair whose posterior exceeds its cutoff.

    The labelling functions vote row by row, once; their votes are written to the
    shared folder, as they are counted and then looked up. The label model needs only how
    often each pattern of votes occurs, at most 3 to the power of a defect's
    functions (243), whatever the number of pairs: those counts, of all pairs,
    are what the driver gets, and the posteriors by pattern go back as a lookup.

    Defined cases: a null or blank answer is ``empty`` and nothing else; null
    questions or contexts only silence the functions that need them; repeated
    rows count each in the model and give one row; an empty table gives an
    empty table; other columns are dropped and may have any name.
    """
    cutoffs = CUTOFFS | (cutoffs or {})
    cast = written(pair_votes(pairs, pair_id, question, answer, contexts))
    at, own = 0, {}
    for d, fs in FUNCTIONS.items():
        own[d] = F.slice("votes", at + 1, len(fs))
        at += len(fs)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), v.alias("pattern")) for d, v in own.items()])).alias("x")
    seen = cast.select(each).select("x.*").groupBy("defect", "pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    lookup = []
    for d in FUNCTIONS:
        rows = [r for r in seen if r["defect"] == d]
        if rows:
            post = label_model(np.array([list(r["pattern"]) for r in rows]), np.array([r["n"] for r in rows]))
            lookup += [(d, list(r["pattern"]), float(p)) for r, p in zip(rows, post, strict=True) if p > cutoffs[d]]
    told = pairs.sparkSession.createDataFrame(lookup, "defect string, pattern array<tinyint>, posterior double")
    out = cast.select("pair_id", each).select("pair_id", "x.*").join(F.broadcast(told), ["defect", "pattern"])
    return out.select("pair_id", "defect", "posterior").distinct()


def main_defect(found: DataFrame) -> DataFrame:
    """``pair_id`` and its one ``defect``: the most telling of several (nothing there, then a refusal, a copy, another language, a cut)."""
    order = {"empty": 0, "refusal": 1, "copies_question": 2, "other_language": 3, "truncated": 4}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("defect"))
    return found.groupBy("pair_id").agg(F.min_by("defect", rank).alias("defect"))
