"""Broken prompt and response pairs, with the kind of each defect."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.lookalikes import canonical
from quern.llm.words import words
from quern.session import spread

#: Bytes that stand for a word when pairs are compressed; no compressor shortens them but by finding the word again.
WORD_BYTES = 16
#: An answer is a copy where it costs at most this part of the bytes of the shorter text given its question, and the
#: question as little given the answer, beside the bytes that any match costs.
COPY_SHARE = 0.1
MATCH_BYTES = 8
#: A kind of end is taken for broken where broken answers explain at least this share of it.
BROKEN_SHARE = 0.4
#: Kinds of end with less than this share of cuts are never judged.
RARE = 0.0001

# Words of placeholders and bare headings, without accents.
PLACEHOLDERS = (
    "n a", "na", "null", "none", "nan", "nil", "undefined", "todo", "tbd", "answer", "response", "empty", "no answer", "reponse",
    "tra loi", "cau tra loi", "dap", "dap an", "noi dung", "ket luan", "trong", "chua co", "dang cap nhat", "khong co", "khong co noi dung",
)
# Phrases that decline, without accents. A sentence with one of them only declines.
REFUSALS = (
    "khong the tra loi", "khong tra loi duoc", "chua tra loi duoc", "chua the tra loi", "tu choi tra loi", "khong the giai dap", "chua the giai dap",
    "khong tim thay can cu", "khong tim thay quy dinh", "khong tim thay thong tin", "khong co can cu", "khong chua can cu", "khong co thong tin", "khong co quy dinh",
    "khong du thong tin", "khong co du thong tin", "chua du thong tin", "khong the ket luan", "khong the ho tro", "khong the giup", "khong ho tro duoc", "khong the cung cap",
    "khong the thuc hien", "xin phep khong", "khong duoc phep", "khong dua ra y kien", "khong the dua ra", "khong the tu van", "ngoai kha nang", "ngoai pham vi", "nam ngoai",
    "can t help", "cannot help", "can not help", "can t answer", "cannot answer", "could not answer", "unable to", "not able to", "can t assist", "cannot assist",
    "can t provide", "cannot provide", "no information", "not enough information", "i must decline", "i decline", "as an ai", "as a language model",
    "je ne peux pas", "je suis desole", "impossible de repondre", "je ne suis pas en mesure",
)
# Phrases of politeness that add nothing to a refusal, without accents.
FILLERS = (
    "mong ban thong cam", "ban co the dat cau hoi khac", "hay thu lai", "vui long lien he", "moi ban hoi", "xin loi", "rat tiec", "cam on ban", "xin cam on", "vui long cung cap",
    "please try again", "please contact", "sorry", "please consult", "merci",
)
# Words without a meaning of their own by language, the same as in any text; Vietnamese ones with and without accents.
FUNCTION_WORDS = {
    "vi": (
        "và của là có không được cho các những một trong khi nếu theo tại về từ với này đó để phải thì sau trước người đã sẽ đang hoặc như còn nay vì do đến ra vào nào ai gì mà cũng"
        " bị bởi nhưng rất nên đây ấy rằng trên dưới giữa ngoài lên xuống vẫn đều chỉ chưa tôi chúng ta họ nó mình bao nhiêu mấy hơn nữa lại rồi sự việc cùng mỗi từng"
    ),
    "vi_bare": (
        "va cua co khong duoc cho cac nhung mot trong khi neu theo tai ve tu voi nay de phai thi sau truoc nguoi da se dang hoac nhu con vi do den ra vao nao ai gi ma cung"
        " bi boi rat nen day ay rang tren duoi giua ngoai len xuong van deu chi chua toi chung ta ho no minh bao nhieu may hon nua lai roi su viec moi tung"
    ),
    "en": (
        "the of and to in is that for it as with on be by at this must may not from or an are was if unless which has have after before when within each any should shall can so what who"
        " my a i we do you your he she they them his her its our their were been will would could had did does there here how where why no yes than then only into about over under between"
    ),
    "fr": (
        "le la les de des du et un une est dans pour que qui sur au aux par ne pas doit ou si ce cette avec dans sont il elle en à peut sauf chaque d l après"
        " je tu nous vous ils elles leur son sa ses mon ma mes été être avoir fait plus mais comme où quand avant sans sous entre"
    ),
    "es": "el la los las y una es en para por con no se que del al su como o si debe sin de un lo más pero sus le ya este sí porque esta entre cuando muy sobre también me hasta hay donde",
    "de": "der die das und ist nicht ein eine mit für auf den dem zu von im wenn muss oder nach des sich auch es an werden aus er hat dass sie bei um noch wie einem über einen so zum war",
    "it": "il lo la i gli le di del della dei delle e è un una in per con non che si da dal alla al come ma se sono nel nella più anche questo deve",
    "pt": "o a os as de do da dos das e é um uma em no na nos nas para por com não que se ao mais como mas foi ele sua ou ser quando muito há já está também só pelo pela deve",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door over naar hij zij wordt moet of deze",
    "pl": "i w z na do nie się jest to że o jak za od po przez dla oraz który są być lub tego tym może czy",
    "id": "yang dan di ke dari untuk dengan pada adalah ini itu tidak dalam akan oleh atau juga sebagai harus dapat telah",
}
_FUNCTION: dict[str, tuple[str, ...]] = {}
for _language, _listed in FUNCTION_WORDS.items():
    for _w in set(_listed.split()):
        _FUNCTION[_w] = (*_FUNCTION.get(_w, ()), _language)

_CITATION = re.compile(r"\[[^\[\]]*\]?|\((?:xem|see)[^()]*\)|^\s*[|].*$", re.M)
_QUOTE = re.compile("“[^”]*”?|«[^»]*»?|\"[^\"]*\"")
_SENTENCE = re.compile(r"[.!?。！？\n]+")
_LAST_MARK = re.compile(r"(?s).*(?:[!?。！？…:\n|]|[.](?!\d))")
_SCRIPTS = (("zh", re.compile("[一-鿿]")), ("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힣]")), ("ru", re.compile("[Ѐ-ӿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("th", re.compile("[฀-๿]")), ("ar", re.compile("[؀-ۿ]")))
#: Letters beyond the Latin alphabet and its marks.
_FAR_LETTER = re.compile("[\u0370-\u1dff\u2c00-\uffff]")
_MARKED = re.compile("[ạ-ỹẠ-ỸăđơưĂĐƠƯ]")
_TOKEN = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W_]+")
_LEAD = re.compile(r"(?i)^\W*(?:câu hỏi|trả lời|hỏi|đáp|question|answer)\s*:")
#: No placeholder has so many words.
MOST_PLACEHOLDER_WORDS = 8


def language(text: str) -> str:
    """Language of the text outside citations and quotes by script and dictionaries of frequent words; '' if it can't be told."""
    t = _QUOTE.sub(" ", _CITATION.sub(" ", text))
    tokens = _TOKEN.findall(t.lower())
    if not tokens:
        return ""
    if _FAR_LETTER.search(t):
        letters = sum(map(len, tokens))
        for name, rx in _SCRIPTS:
            if len(rx.findall(t)) * 2 > letters:
                return name
    n = Counter(dict.fromkeys(FUNCTION_WORDS, 0))
    for found in map(_FUNCTION.get, tokens):
        if found:
            for k in found:
                n[k] += 1
    marked = len(_MARKED.findall(t))
    vi = max(n.pop("vi") + marked / 2, n.pop("vi_bare") * (0.9 if not marked else 0.5))
    name, most = n.most_common(1)[0]
    if max(vi, most) < 1:
        return ""
    return "vi" if vi >= most else name


def _cost(text: bytes, given: bytes) -> int:
    """Bytes of the text in zstandard with the given text as dictionary, beyond an empty frame."""
    d = zstandard.ZstdCompressionDict(given, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False).compress(text)) - 9


@lru_cache(maxsize=200_000)
def _word_code(word: str) -> bytes:
    return hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()


def _allowed(n_words: int) -> float:
    return MATCH_BYTES + COPY_SHARE * WORD_BYTES * n_words


def copies(question: list[str], answer: list[str]) -> bool:
    """True if an answer says nothing beyond its question, of whatever length and however often: each costs almost nothing given the other."""
    if not question or not answer:
        return False
    q, a = b"".join(map(_word_code, question)), b"".join(map(_word_code, answer))
    most = _allowed(min(len(question), len(answer)))
    return _cost(a, q) <= most and _cost(q, a) <= most


def may_copy(question: list[str], answer: str, step: int = 160) -> bool:
    """False only where an answer can't be a copy: each of its words the question doesn't have costs all its bytes, so with too many of them it isn't one.

    The answer is read until there are too many; an answer that is a copy is read to its end.
    """
    if not question:
        return False
    known, new, most = set(question), set(), _allowed(len(question)) / WORD_BYTES
    at = 0
    while at < len(answer):
        end = at + step
        while end < len(answer) and not answer[end].isspace():
            end += 1
        new.update(w for w in words(answer[at:end]) if w not in known)
        if len(new) > most:
            return False
        at = end
    return True


def is_empty(text: str | None) -> bool:
    """True for null, nothing but space and punctuation, a bare heading or a placeholder."""
    if text is None:
        return True
    if sum(1 for _ in islice(_WORD.finditer(text), MOST_PLACEHOLDER_WORDS)) < MOST_PLACEHOLDER_WORDS:
        w = " ".join(words(text))
        if not w and not _WORD.search(text) or w in PLACEHOLDERS:
            return True
    return all(s.lstrip("> ").startswith("#") for s in (x.strip() for x in text.split("\n")) if _WORD.search(s))


def is_refusal(text: str) -> bool:
    """True if every sentence declines or is politeness, and at least one declines."""
    hit = False
    for sentence in _SENTENCE.split(_CITATION.sub(" ", text)):
        s = " ".join(words(sentence))
        if not s:
            continue
        # what comes after "but" is what the sentence says
        said = re.split(r"\b(?:nhung|but|mais)\b", s)[-1]
        if any(p in said for p in REFUSALS) and not said.endswith("nhu sau"):
            hit = True
        elif not any(p in s for p in FILLERS):
            return False
    return hit


def terminal_context(text: str) -> str:
    """What the end of a text looks like: kind of its last sign, an open bracket, and how much stands since the last mark."""
    t = text.rstrip()
    bare = t.rstrip("*_`>\"”’» ​")
    last = bare[-1:]
    kind = "mark" if last in ".!?。！？…" and last else "close" if last in "])}|" and last else "colon" if last == ":" else "cut" if last in ",;([{-–/" and last else "other"
    open_ = bare.rfind("[") > bare.rfind("]") or bare.rfind("(") > bare.rfind(")")
    m = _LAST_MARK.match(bare)
    tail = bare[m.end() :] if m else bare
    n = len(re.findall("[぀-ヿ一-鿿]|[^\\W_]+", tail))
    alone = len(tail.strip()) >= len(bare.strip()) - 1
    size = "0" if n == 0 else "1-6" if n <= 6 else "7+"
    return f"{kind} {'open' if open_ else 'shut'} {size} {'alone' if alone else 'after'}"


def cut_points(text: str, cuts: int = 8) -> list[str]:
    """Texts that break off, made from one by cutting it at even shares of its length."""
    return [text[: len(text) * i // (cuts + 1)] for i in range(1, cuts + 1) if len(text) > cuts]


class TerminalModel:
    """Chance that a text with this end breaks off, from counts of real ends and of ends made by cutting.

    Real ends are a mixture of complete and broken ones. The broken share is told by the kinds of end with the fewest
    real ends per cut that together hold half of all cuts. A kind is taken for broken where that share explains
    at least ``least`` of its real ends.
    """

    def __init__(self, ends: dict[str, int], cuts: dict[str, int], least: float = BROKEN_SHARE):
        n_ends, n_cuts = max(sum(ends.values()), 1), max(sum(cuts.values()), 1)
        ratio = {c: (ends.get(c, 0) / n_ends) / (n / n_cuts) for c, n in cuts.items()}
        held_ends = held_cuts = 0
        for c in sorted(ratio, key=lambda c: (ratio[c], c)):
            held_ends, held_cuts = held_ends + ends.get(c, 0), held_cuts + cuts[c]
            if held_cuts * 2 >= n_cuts:
                break
        self.share = (held_ends / n_ends) / (held_cuts / n_cuts) if held_cuts else 0.0
        # one real end is no evidence against, as little data has many kinds seen once; a kind never seen is broken too
        self.broken = {c for c, n in cuts.items() if (max(ends.get(c, 0) - 1, 0) / n_ends) / (n / n_cuts) * least <= self.share and n > RARE * n_cuts}

    def breaks_off(self, text: str) -> bool:
        return terminal_context(text) in self.broken


def train_terminal(df: DataFrame, answer: str) -> TerminalModel:
    """Counts contexts of ends and cuts over all answers on the executors; there are at most a few dozen contexts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: Counter = Counter()
        cuts: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                t = t[0] if isinstance(t, tuple) else t
                if not is_empty(t):
                    ends[terminal_context(t)] += 1
                    cuts.update(map(terminal_context, cut_points(t)))
        yield pd.DataFrame([(c, False, n) for c, n in ends.items()] + [(c, True, n) for c, n in cuts.items()], columns=["context", "cut", "n"])

    rows = (
        spread(df.select(F.col(answer).alias("t")).where("t is not null"))
        .mapInPandas(count, "context string, cut boolean, n bigint")
        .groupBy("context", "cut")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return TerminalModel({r["context"]: r["n"] for r in rows if not r["cut"]}, {r["context"]: r["n"] for r in rows if r["cut"]})


@lru_cache(maxsize=10_000)
def _question(question: str) -> tuple[list[str], str]:
    """Words and language of a question; questions are asked again and again."""
    q = canonical(question)
    return words(q), language(q)


def defects(question: str | None, answer: str | None, expects_refusal: bool, model: TerminalModel) -> list[str]:
    """All defects of a pair. An empty answer has no other; a copied or refusing one isn't truncated."""
    if is_empty(answer):
        return ["empty"]
    asked_words, asked = _question(question or "")
    a = canonical(answer)
    found = []
    said = _LEAD.sub("", a)
    copied = may_copy(asked_words, said) and copies(asked_words, words(said))
    if copied:
        found.append("copies_question")
    refused = is_refusal(a)
    if refused and not expects_refusal:
        found.append("refusal")
    if not copied and not refused and model.breaks_off(a):
        found.append("truncated")
    spoken = language(a) if asked else ""
    if spoken and spoken != asked:
        found.append("other_language")
    return found


def broken_pairs(df: DataFrame, key: str = "result_id", question: str = "question", answer: str = "answer", gap_type: str = "gap_type") -> DataFrame:
    """One row for each defect of a pair: ``key, defect``.

    Defects: 'empty', 'truncated', 'refusal' (unless gap_type is 'negative'), 'copies_question', 'other_language'. A null
    question has no language and nothing to copy; a null gap_type expects an answer. Two passes over the answers: one
    to train the model of ends, one to judge; no shuffle but that of a few dozen counts.
    """
    shared = df.sparkSession.sparkContext.broadcast(train_terminal(df, answer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = [(k, d) for k, q, a, neg in zip(b["key"], b["q"], b["a"], b["neg"]) for d in defects(q, a, neg, m)]
            yield pd.DataFrame(rows, columns=["key", "defect"])

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(question).alias("q"), F.col(answer).alias("a"), F.coalesce(F.col(gap_type) == "negative", F.lit(False)).alias("neg"))
    return spread(rows).mapInPandas(run, f"key {kind}, defect string")
