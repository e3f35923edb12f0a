"""Text garbled by decoding with the wrong character set: find it, name the chain, undo it.

A multinomial classifier over hashed bigrams of UTF-8 bytes is trained on clean lines of the records
that are garbled here by every chain of ``CHAINS`` (the
character set the text was in, the one it was read with, once or twice over) and on
the same lines unharmed. The lines are a sample of at most ``SAMPLE_LINES`` different ones, chosen by a hash from all rows;
which of them are clean is told by a first classifier of the same kind, trained on fixed sentences of many languages.
Each line that isn't ASCII is classified. If a chain
beats "unharmed", it is inverted: the line is encoded with the wrong
set and decoded with the right one, strictly, and the outcome must itself be
classified as unharmed, or be made of the frequent characters of an East Asian set. Lines that lost characters on the way (U+FFFD beside a
letter, or a chain that inverts for most but not all of the damaged stretches)
are found, but not restored; nor are lines that two chains explain about equally well by different texts, or whose only
explanation mixes scripts or cases within a word, tears words, or gives kana in a set for another language.

Chains that start from UTF-8 prove themselves, since other text is hardly ever
valid UTF-8. The other chains decode almost anything, so they need log odds of ``EVIDENCE`` in a line and of ``MARGIN``
a character, and a stretch of ``MIN_RUN`` characters or words torn by what can't stand in one. Lines with less, as Western
text sent through a one-byte table, are judged together, record by record (``pooled``).

Defined results: null, empty and ASCII texts are unharmed; a text is garbled if one line is.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 8192
#: Lines of the records from which the classifier is trained, at most; longer ones aren't among them.
SAMPLE_LINES, SAMPLE_CHARS = 1000, 400
#: Log odds against "unharmed" that a line needs for a chain that doesn't start from UTF-8.
EVIDENCE = 12.0
#: Log odds within which another chain makes a restored text doubtful.
DOUBT = 3.0
#: Characters of a damaged stretch that the lines of a record need between them.
MIN_RUN = 5
#: Log odds a character against "unharmed" for such a chain.
MARGIN = 0.35
#: Log odds, and letters in torn words, that the shorter lines of a record need together.
POOLED, MIN_TORN = 20.0, 8

# Sentences of the training set, by language; all are garbled by every chain that can express them.
SEEDS = """
Über die Größe der Lücke müssen wir später noch einmal ausführlich sprechen, schöne Grüße
Äpfel, Öl und Übung: für fünf Wörter genügt ein kürzerer Brief während der Prüfung
Außerdem könnten süße Brötchen übrig bleiben, bevor die Gäste aus München möglichst früh zurückkehren
Não há exceção à regra: a estação só é bonita até a próxima manhã, então começa já
A posição três não está disponível; você também precisa de atenção, pão e um coração
El niño pequeño añadió según él una canción más en la última página del año después
¿Qué página está vacía? También hay un café único y un día de corazón
Où est passé l'élève français ? Déjà à la fête, il préfère la crème brûlée naïve de sa sœur
Près de la forêt, un écureuil âgé a été réveillé par la lumière ; même gêné, il répétait sa leçon
Il caffè è più forte perché così è la città; però già lunedì c'è un'attività nuova
Zażółć gęślą jaźń, święty źrebak wśród łąk i pól, dlaczego jeszcze późno
Příliš žluťoučký kůň úpěl ďábelské ódy během dlouhého večera u řeky
Să știți că și în țară există o mulțime de înțelepți bătrâni
Ağaç gölgesinde üç çocuk şarkı söylüyor, ıslak çimenlerde güneş doğuyor
Räksmörgås på en ö är gott för både små och stora, säger hon över älven
Smørrebrød på en ø, få år før blåbærgrød, nærmere æblerne
Árvíztűrő tükörfúrógép működik a tűzoltók öt órája óta
Бабушка испекла пирог с яблоками и пригласила соседей на ужин, а дедушка играл с внуками во дворе
Сегодня хорошая погода, мы идём гулять в парк вместе с друзьями и их детьми
Зимой реки замерзают, снег лежит на крышах, а вечером в окнах горит тёплый свет
Учитель спросил, почему птицы улетают на юг; ученики ответили, что там теплее и больше пищи
Эта книга рассказывает об истории города, его площадях, церквях и шумных ярмарках прошлого века
Ошибки в диктанте учитель подчеркнул красным, и каждый исправил их дома; Опасно ходить по тонкому льду
Привіт, як справи? Їжак і ґава живуть у лісі біля річки, є ще й ведмідь
Η γιαγιά έψησε ψωμί και το σπίτι μύριζε όμορφα, ενώ έξω έπεφτε ήσυχα το χιόνι
Ο γρήγορος σκύλος πήδηξε πάνω από τον φράχτη και έτρεξε προς τη θάλασσα με τα παιδιά
Σήμερα το πρωί αγοράσαμε φρούτα στην αγορά, αύριο θα πάμε εκδρομή στο νησί
הסבתא אפתה לחם והבית התמלא בריח טוב, בחוץ ירד גשם חזק כל הלילה
הילדים הלכו לטייל ביער ליד הנהר עם הכלב שלהם, ואחר כך חזרו הביתה לאכול
خبزت الجدة الخبز وامتلأ البيت برائحة طيبة بينما كان المطر يهطل في الخارج
ذهب الأطفال إلى الحديقة مع أصدقائهم ولعبوا بالكرة حتى غروب الشمس
奶奶烤了面包 整个屋子都很香 外面的雪下得很大
春天来了 花园里的花都开了 孩子们在河边放风筝
我们今天要去山上看日出 请注意安全 谢谢大家
昨天晚上他给远方的朋友写了一封很长的信 说这里的冬天非常冷
老师问学生为什么鸟会飞到南方 学生回答说那里更暖和
春天的早晨 大家一起在公園散步 聽見小鳥在樹上唱歌 覺得非常開心
おばあさんがパンを焼いて 家じゅうがいい匂いになりました
今日は良い天気ですね 友達と一緒に公園へ行きましょう
冬の朝 山の上に白い雪が見えて とても静かでした
先生は生徒に 鳥がなぜ南へ飛ぶのかを尋ねました
할머니가 빵을 구워서 온 집안에 좋은 냄새가 났습니다
오늘은 날씨가 좋아서 친구들과 함께 공원에 산책하러 갑니다
“Don’t panic” — it’s the reader’s turn… or isn’t it? See ‘late’ pages 3–9
Wait… the teacher’s “second” answer won’t do — a note on 10–12 • chapter
The price is 5 € or 4 £, the angle 90° ± 2°, x ≤ y ≥ z ≠ w, µ ≈ 3 · 10²
""".strip().split("\n")

# Unharmed text that looks odd: symbols, capitals, frames, single letters.
SYMBOLS = """
½ § © ¥ ® ¶ £ ¢ ¤ ¿ ¡ « » ¼ ¾ ¹ ² ³ × ÷ ± ° µ
×÷±° ±°×÷ §§ ©® ½¼¾ €£¥ °C ±5 «guillemets» ·•·
ÄÖÜ ÃÕ Å ÉÈÊ ÀÂ ÇÑ ØÆ ÁÍÓÚ ÎÔÛ
ÇA VA, MÊME À NOËL: ÜBERRASCHUNG, CORAÇÃO, PIÑATA
Ð and Ñ stay, Ã or Â too, Þ þ ð Æ æ ß ø å â ã
┌──┐ │ └──┘ ├─┤ ╔══╗ ║ ╚══╝ ░▒▓█ ▄▀ ■□▪
→ ← ↑ ↓ ⇒ ∀ ∃ ∈ ∑ √ ∞ ∂ ∫ ≈ ≠ ≤ ≥ √2 √x ∞ Ω π
α β γ δ ε λ μ σ φ ω Δ Σ Ω α+β
✓ ✗ ★ ☆ ♥ 😀 🎉 👍 ™ † ‡ ‰ … – — “” ‘’
“so” “it goes”, ‘and on’ “an old house:”, {“a”: 5} “%d-%s”
""".strip().split("\n")

#: (set the bytes were in, set they were read with).
_UTF8_READERS = "latin-1 cp1252 cp1250 iso8859-2 cp437 cp850 cp866 cp1251 cp1253 cp1255 cp1256 koi8-r mac-roman gbk big5 shift_jis euc_kr".split()
_OTHERS = [
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "latin-1"), ("cp1251", "latin-1"),
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("gbk", "latin-1"), ("gbk", "cp1252"), ("big5", "latin-1"), ("shift_jis", "latin-1"),
    ("shift_jis", "cp1252"), ("euc_jp", "latin-1"), ("euc_jp", "cp1252"), ("euc_kr", "latin-1"), ("cp1252", "cp1251"), ("cp1252", "mac-roman"),
    ("iso8859-7", "latin-1"), ("cp1253", "cp1252"), ("cp1255", "latin-1"), ("cp1255", "cp1252"), ("cp1256", "latin-1"), ("cp1256", "cp1252"), ("mac-roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "koi8-r"),
]
CHAINS: list[tuple[tuple[str, str], ...]] = (
    [(("utf-8", d),) for d in _UTF8_READERS]
    + [(("utf-8", d),) * 2 for d in ("latin-1", "cp1252", "cp437", "mac-roman", "cp1251")]
    + [(pair,) for pair in _OTHERS]
)
#: Chains on which every character that isn't ASCII is lost.
LOST = [(("utf-8", "ascii"),), (("latin-1", "utf-8"),)]


def _read(data: bytes, charset: str, errors: str = "strict") -> str:
    """Decode; bytes a Windows code page leaves open become the characters of that number, as browsers have it."""
    try:
        return data.decode(charset, errors)
    except UnicodeDecodeError:
        if not charset.startswith("cp125"):
            raise
        return "".join(_read_byte(b, charset) for b in data)


@lru_cache(None)
def _read_byte(b: int, charset: str) -> str:
    try:
        return bytes([b]).decode(charset)
    except UnicodeDecodeError:
        return chr(b)


def _written(text: str, charset: str) -> bytes:
    """The inverse of ``_read``."""
    try:
        return text.encode(charset)
    except UnicodeEncodeError:
        if not charset.startswith("cp125"):
            raise
        return b"".join(_written_char(c, charset) for c in text)


@lru_cache(50_000)
def _written_char(c: str, charset: str) -> bytes:
    try:
        return c.encode(charset)
    except UnicodeEncodeError:
        if ord(c) < 256 and _read_byte(ord(c), charset) == c:
            return bytes([ord(c)])
        raise


def garble(text: str, chain: tuple[tuple[str, str], ...], errors: str = "strict") -> str:
    """Send a text down a chain; raises UnicodeError where a character can't pass."""
    for right, wrong in chain:
        text = _read(text.encode(right), wrong, errors)
    return text


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """Undo a chain; raises UnicodeError where the text can't have come from it."""
    for right, wrong in reversed(chain):
        text = _written(text, wrong).decode(right)
    return text


_FOREIGN = re.compile(r"[A-Za-z]?[^\x00-\x7f]+(?:[ -~]?[^\x00-\x7f]+)*[A-Za-z]?")
_HASH = np.array([zlib.crc32(bytes([a, b])) % BUCKETS for a in range(256) for b in range(256)], np.int32)


def _features(text: str) -> np.ndarray:
    """Hashed bigrams of the bytes of the stretches that aren't ASCII."""
    parts = [np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32) for s in _FOREIGN.findall(text)]
    return np.concatenate([_HASH[p[:-1] * 256 + p[1:]] for p in parts if len(p) > 1] or [np.zeros(0, np.int32)])


class Classifier:
    """Multinomial naive Bayes; class 0 is "unharmed", class k the chain ``(CHAINS + LOST)[k - 1]``.

    ``clean`` are lines that are taken as unharmed, besides the fixed sentences; every line is also sent down every chain.
    """

    def __init__(self, clean: Iterable[str] = ()) -> None:
        clean = list(clean)
        counts = np.full((len(CHAINS + LOST) + 1, BUCKETS), 0.02)
        for line in SEEDS + [x.upper() for x in SEEDS] + SYMBOLS * 10 + clean:
            np.add.at(counts[0], _features(line), 1.0)
        whole = [w for line in SEEDS for w in (line, *line.split())] + clean
        for k, chain in enumerate(CHAINS + LOST, 1):
            found = []
            for text in whole:
                try:
                    broken = garble(text, chain, "replace")
                except UnicodeError:  # the right set hasn't all its characters
                    continue
                if broken != text:
                    found.append(_features(broken))
            counts[k] += np.bincount(np.concatenate(found), minlength=BUCKETS)
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    @classmethod
    def trained(cls, lines: Iterable[str]) -> Classifier:
        """Trained on those of the lines that a classifier of the fixed sentences alone has nothing against."""
        first = cls()
        return cls([line for line in lines if first.examine(line) == (("", 0, None), {})])

    def scores(self, text: str) -> np.ndarray:
        """Log-likelihood of each class."""
        return self.logs[:, _features(text)].sum(axis=1)

    @staticmethod
    def _undone(line: str, k: int) -> str | None:
        try:
            text = restore(line, CHAINS[k - 1])
        except UnicodeError:
            return None
        return text if text != line else None

    def _sound(self, text: str, slack: float) -> bool:
        """Whether a text is itself classified as unharmed, or nearly."""
        s = self.scores(text)
        return s[0] > s.max() - slack

    def _doubtful(self, line: str, s: np.ndarray, k: int, text: str) -> bool:
        """Whether another chain explains the line about as well, by a text that is as sound."""
        for other in np.flatnonzero(s[: len(CHAINS) + 1] > s[k] - DOUBT):
            if other and other != k:
                instead = self._undone(line, int(other))
                if instead is not None and instead != text and _plausible(instead, CHAINS[other - 1][0][0]) and (self._sound(instead, 0.01) or _frequent(instead, CHAINS[other - 1][0][0])):
                    return True
        return False

    def diagnose(self, line: str) -> tuple[str, int, str | None]:
        """("" or "garbled", number of the chain or 0, restored line or None)."""
        return self.examine(line)[0]

    def examine(self, line: str) -> tuple[tuple[str, int, str | None], dict[int, tuple[float, str]]]:
        """The line's diagnosis, and for a line too short for one, log odds and restored line of each chain that explains it."""
        s = self.scores(line)
        weak: dict[int, tuple[float, str]] = {}
        if "�" in line and re.search(r"[^\W\d_]�|�[^\W\d_]", line):
            return ("garbled", int(s[1:].argmax()) + 1, None), weak
        runs = re.findall(r"[^\x00-\x7f]+", line)
        foreign = sum(map(len, runs))
        doubtful = 0
        for k in np.argsort(-s):
            if k == 0:
                break
            if k > len(CHAINS):
                continue
            chain = CHAINS[k - 1]
            from_utf8 = chain[0][0] == "utf-8"
            if not from_utf8 and s[k] - s[0] < MARGIN * foreign:
                continue
            text = self._undone(line, int(k))
            if text is None:
                continue
            if from_utf8 or s[k] - s[0] >= EVIDENCE and _shaped([line]) and (self._sound(text, 1.0) or _frequent(text, chain[0][0])):
                if not from_utf8 and not _plausible(text, chain[0][0]):
                    doubtful = doubtful or int(k)
                    continue
                return ("garbled", int(k), text if from_utf8 or not self._doubtful(line, s, int(k), text) else None), weak
            if self._sound(text, max(1.0, 0.25 * (s[k] - s[0]))):
                weak[int(k)] = float(s[k] - s[0]), text
        if doubtful:
            return ("garbled", doubtful, None), weak
        # Damage that isn't whole any more: most stretches still invert.
        best = int(s[1 : len(CHAINS) + 1].argmax()) + 1
        if s[best] > s[0] and CHAINS[best - 1][0][0] == "utf-8":
            good = 0
            for run in runs:
                try:
                    good += restore(run, CHAINS[best - 1]) != run
                except UnicodeError:
                    pass
            if good and good * 2 >= len(runs):
                return ("garbled", best, None), {}
        return ("", 0, None), weak


def _plausible(text: str, charset: str) -> bool:
    """Whether no word mixes scripts, is torn, or has a capital after a small letter that isn't ASCII, and no kana come from a set for another language."""
    if _HALF_WIDTH.search(text) or charset in ("gbk", "big5", "euc_kr") and _KANA.search(text) or _torn_words(text):
        return False
    for word in _LETTERS.findall(text):
        if not word.isascii():
            if len({_script(c) for c in word} - {""}) > 1 or _humped(word):
                return False
    return True


_KANA, _HALF_WIDTH = re.compile("[\u3041-\u30ff]"), re.compile("[\uff61-\uff9f]")


# Lead bytes of the frequent characters (level 1, syllables) of East Asian sets.
_FREQUENT = {"gbk": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "euc_jp": (0xA4, 0xCF), "shift_jis": (0x82, 0x97), "euc_kr": (0xB0, 0xC8)}


def _frequent(text: str, charset: str) -> bool:
    """Whether nearly all characters are frequent ones of an East Asian character set."""
    if charset not in _FREQUENT:
        return False
    low, high = _FREQUENT[charset]
    leads = [c.encode(charset, "replace")[0] for c in text if c > "\u2e7f" and c < "\uff00"]
    return len(leads) >= 4 and sum(low <= x <= high for x in leads) >= 0.95 * len(leads)


_LETTERS = re.compile(r"[^\W\d_]+")


def _humped(word: str) -> bool:
    return any(a.islower() and b.isupper() and not (a.isascii() and b.isascii()) for a, b in zip(word, word[1:]))


@lru_cache(100_000)
def _script(c: str) -> str:
    """The alphabet of a letter; "" for other scripts."""
    name = unicodedata.name(c, "").split(" ")[0]
    return name if name in ("LATIN", "CYRILLIC", "GREEK", "HEBREW", "ARABIC") else ""


_LINE = re.compile(r"[^\n\r]*[^\x00-\x7f\n\r][^\n\r]*")
# A letter or sign inside a word that can't stand there, as in "fьr", "f³r" or "f‰r".
_TORN = re.compile(r"[A-Za-z]*[a-z][^\x00-\x7f]+[a-z][A-Za-z]*")


def _torn_words(line: str) -> set[str]:
    return {w for w in _TORN.findall(line) if any(not (c.islower() and unicodedata.name(c, "").startswith("LATIN")) for c in w if not c.isascii())}


def _shaped(lines: list[str]) -> bool:
    """Whether lines have a stretch of ``MIN_RUN`` characters that aren't ASCII, or two different torn words with ``MIN_TORN`` letters between them.

    Single symbols and capitals, which many sets have in the same places, do not.
    """
    torn = set().union(*map(_torn_words, lines))
    return len(torn) > 1 and sum(map(len, torn)) >= MIN_TORN or any(len(run) >= MIN_RUN for line in lines for run in re.findall(r"[^\x00-\x7f]+", line))


def pooled(lines: dict[str, dict[int, tuple[float, str]]]) -> int:
    """The chain that the short lines of one record prove together, or 0.

    Its log odds over the different lines reach ``POOLED``, and the lines are shaped like damaged ones (``_shaped``).
    """
    odds: dict[int, float] = defaultdict(float)
    for weak in lines.values():
        for k, (gain, _) in weak.items():
            odds[k] += gain
    for k in sorted(odds, key=lambda k: (-odds[k], k)):
        if odds[k] < POOLED:
            break
        if _shaped([line for line, weak in lines.items() if k in weak]):
            return k
    return 0


def _mapper(model: Classifier, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[tuple[str, int, str | None], dict[int, tuple[float, str]]]] = {}
        for batch in batches:
            rows, chains, lines, lost, texts = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text or text.isascii():
                    continue
                found, short = [], []
                for m in _LINE.finditer(text):
                    line = m.group()
                    both = seen.get(line)
                    if both is None:
                        if len(seen) > 50_000:
                            seen.clear()
                        both = seen[line] = model.examine(line)
                    verdict, weak = both
                    if verdict[0]:
                        found.append((m.span(), verdict))
                    elif weak:
                        short.append((m.span(), line, weak))
                if short and (k := pooled({line: weak for _, line, weak in short})):
                    found = sorted([*found, *((span, ("garbled", k, weak[k][1])) for span, _, weak in short if k in weak)], key=lambda x: x[0])
                if not found:
                    continue
                gone = sum(v[2] is None for _, v in found)
                numbers = [v[1] for _, v in found]
                rows.append(row)
                chains.append(" then ".join("/".join(p) for p in (CHAINS + LOST)[max(set(numbers), key=lambda k: (numbers.count(k), -k)) - 1]))
                lines.append(len(found))
                lost.append(gone)
                if whole:
                    parts, at = [], 0
                    for (a, b), (_, _, new) in found:
                        parts += [text[at:a], text[a:b] if new is None else new]
                        at = b
                    texts.append("".join(parts) + text[at:])
                else:
                    texts.append(None)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(chains), pa.array(lines, pa.int32()), pa.array(lost, pa.int32()), pa.array(texts, pa.string())],
                    ["id", "chain", "garbled_lines", "lost_lines", "restored"],
                )

    return run


def garbled(df: DataFrame, id_col: str, text_col: str, restored: bool = True) -> DataFrame:
    """``id``, ``chain``, ``garbled_lines``, ``lost_lines``, ``restored``: one row for each garbled record.

    ``chain`` is the one most of its lines went through; ``lost_lines`` are those that can't
    be restored and stay as they are; ``restored`` is null if not asked for.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    model = Classifier.trained(sample_lines(rows, "text"))
    return rows.mapInArrow(_mapper(model, restored), f"id {kind}, chain string, garbled_lines int, lost_lines int, restored string")


def sample_lines(df: DataFrame, text_col: str) -> list[str]:
    """At most ``SAMPLE_LINES`` different lines that aren't ASCII, by a hash over all rows."""
    lines = df.select(F.explode(F.filter(F.split(text_col, "[\\r\\n]+"), lambda x: x.rlike("[^\\x00-\\x7F]") & (F.length(x) <= SAMPLE_CHARS))).alias("line"))
    return [r["line"] for r in lines.groupBy("line").agg(F.lit(1)).orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).select("line").collect()]


def held_out(lines: list[str], part: int = 4) -> list[tuple[str, str, int, int, int, int]]:
    """Train on all but every ``part``-th line and garble those: (chain, length class, tried, found, restored, restored to something else)."""
    first = Classifier()
    clean = [x for x in lines if first.examine(x) == (("", 0, None), {})]
    model = Classifier(x for i, x in enumerate(clean) if i % part)
    out: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0] * 4)
    for line in clean[::part]:
        for chain in CHAINS:
            try:
                broken = garble(line, chain)
            except UnicodeError:
                continue
            if broken == line:
                continue
            n = sum(not c.isascii() for c in line)
            verdict = model.diagnose(broken)
            row = out[" then ".join("/".join(p) for p in chain), "1-4" if n < 5 else "5-9" if n < 10 else "10+"]
            row[0] += 1
            row[1] += verdict[0] == "garbled"
            row[2] += verdict[2] == line
            row[3] += verdict[2] not in (None, line)
    return [(*k, *v) for k, v in sorted(out.items())]
