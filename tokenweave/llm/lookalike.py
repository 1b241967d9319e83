"""Text that looks the same in other characters: one consistent form.

A value is brought to: canonical composition (NFC), no invisible characters, no blanks at its ends,
and in each word only the ordinary letters and digits of one script. The script of a word is Greek
if at least half of its letters are Greek, else the most frequent one; letters of other scripts are
replaced by the look-alike of the word's script. Words of one script, letter case and visible
accents stay as they are.

Some letters look like two of the other script. Which one stands there is settled by the words of the corpus:
the first reading that is one of them counts, and the usual one if none is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.unicode import char_class, per_distinct
from ..session import cut, small

def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


# A letter and the Greek letter it looks like, of Latin and of Cyrillic.
LATIN_TO_GREEK = _pairs(
    "aα bβ cσ dδ eε fφ gγ hη iι kκ lι mμ nη oο pρ qφ rρ sσ tτ uυ vν wω xχ yγ zζ "
    "AΑ BΒ CΣ DΔ EΕ FΦ GΓ HΗ IΙ KΚ LΛ MΜ NΝ OΟ PΡ QΟ RΡ SΣ TΤ UΥ VΝ WΩ XΧ YΥ ZΖ"
)
CYRILLIC_TO_GREEK = _pairs(
    "аα бβ вβ гγ дδ еε зζ иη кκ лλ мμ нη оο пπ рρ сσ тτ уυ фφ хχ іι јι ѕσ ѵν "
    "АΑ БΒ ВΒ ГΓ ДΔ ЕΕ ЗΖ ИΗ КΚ ЛΛ МΜ НΗ ОΟ ПΠ РΡ СΣ ТΤ УΥ ФΦ ХΧ ІΙ ЈΙ ЅΣ ѴΝ"
)
# A letter and the Latin letter it looks like, of Greek and of Cyrillic.
GREEK_TO_LATIN = _pairs(
    "αa βb γy εe ζz ηn ιi κk λl μu νv οo πn ρp σo ςc τt υu χx ωw "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
)
CYRILLIC_TO_LATIN = _pairs("аa вb еe кk мm нh оo пn рp сc тt уy хx іi јj ѕs АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS")
# A letter and the Cyrillic letter it looks like, of Greek and of Latin.
GREEK_TO_CYRILLIC = _pairs("αа βв γг εе κк νи οо πп ρр σо ςс τт υу φф χх ΑА ΒВ ΓГ ΕЕ ΚК ΜМ ΗН ΟО ΠП ΡР ΤТ ΥУ ΦФ ΧХ")
LATIN_TO_CYRILLIC = _pairs("aа bв cс eе hн iі jј kк mм nп oо pр sѕ tт uи xх yу AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ")
INTO = {"GREEK": LATIN_TO_GREEK | CYRILLIC_TO_GREEK, "LATIN": CYRILLIC_TO_LATIN | GREEK_TO_LATIN, "CYRILLIC": GREEK_TO_CYRILLIC | LATIN_TO_CYRILLIC}

# A letter and a second Greek letter that it looks like.
SECOND_GREEK = _pairs("vυ uμ yυ nπ уγ нν иι")

_VISIBLE_CONTROL = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"
# Characters without a mark of their own outside category Cf.
_UNSEEN = set("͏ᅟᅠ឴឵ㅤﾠ") | {chr(c) for c in range(0xFE00, 0xFE10)} | {chr(c) for c in range(0x180B, 0x1810)}
_LOOK_TAGS = ("<wide>", "<narrow>", "<compat>", "<font>")


@lru_cache(maxsize=65536)
def _invisible(ch: str) -> bool:
    kind = unicodedata.category(ch)
    return kind == "Cf" or ch in _UNSEEN or kind == "Cc" and ch not in _VISIBLE_CONTROL


@lru_cache(maxsize=65536)
def _ordinary(ch: str) -> str:
    """The ordinary letter or digit of one that only differs in style (full-width, symbol letters)."""
    if unicodedata.category(ch)[0] in "LN" and unicodedata.decomposition(ch).startswith(_LOOK_TAGS):
        plain = unicodedata.normalize("NFKC", ch)
        if all(unicodedata.category(c)[0] in "LNM" for c in plain):
            return plain
    return ch


@lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    """The script of a letter, '' for other characters; mathematical and like letters count by their name."""
    return unicodedata.name(ch, "").split(" ")[0] if unicodedata.category(ch)[0] == "L" else ""


def _one_script(word: str, second: frozenset[str] = frozenset()) -> tuple[str, set[str]]:
    """word in the ordinary letters of one script, and the letters of another one that were replaced; those in `second` by
    the second letter they look like."""
    marks = unicodedata.normalize("NFD", "".join(map(_ordinary, word)))
    counts: dict[str, int] = {}
    for ch in marks:
        if s := _script(ch):
            counts[s] = counts.get(s, 0) + 1
    if len(counts) < 2:
        return unicodedata.normalize("NFC", _sigmas(word, marks)), set()
    greek = counts.get("GREEK", 0)
    script = "GREEK" if 2 * greek >= sum(counts.values()) else max(sorted(counts), key=counts.get)
    into = INTO.get(script, {})
    if second and script == "GREEK":
        into = into | {ch: SECOND_GREEK[ch] for ch in second}
    replaced = {ch for ch in _foreign(marks, script) if ch in into}
    out = "".join(into[ch] if ch in replaced else ch for ch in marks)
    return unicodedata.normalize("NFC", _sigmas(word, out)), replaced


def _foreign(marks: str, script: str) -> set[str]:
    """The letters of marks that are of another script."""
    return {ch for ch in marks if _script(ch) not in ("", script)}


def _sigmas(word: str, marks: str) -> str:
    """marks with each sigma in place of a lunate or foreign one written for its place in the word."""
    if not any(c in word for c in "ϲcсｃsｓ"):
        return marks
    letters = [i for i, ch in enumerate(marks) if unicodedata.category(ch)[0] == "L"]
    out = list(marks)
    for k, i in enumerate(letters):
        if out[i] in "σς":
            out[i] = "ς" if k == len(letters) - 1 else "σ"
    return "".join(out)


_BLANKS = re.compile(r"(\s+)")
_PLAIN = re.compile(r"[!-~]*\Z")


def _consistent_by(value: str, second: frozenset[str] = frozenset()) -> tuple[str, set[str]]:
    if _PLAIN.match(value):
        return value, set()
    seen = "".join(ch for ch in value if not _invisible(ch)).strip()
    seen = unicodedata.normalize("NFC", seen)
    swapped: set[str] = set()
    out = []
    for part in _BLANKS.split(seen):
        if part and not part.isspace():
            part, s = _one_script(part, second)
            swapped |= s
        out.append(part)
    return "".join(out), swapped


@lru_cache(maxsize=4096)
def consistent(value: str) -> tuple[str, bool]:
    """The consistent form of a value, and whether letters of another script were replaced in it."""
    form, swapped = _consistent_by(value)
    return form, bool(swapped)


def readings(value: str) -> list[str]:
    """The forms that a value with replaced letters may have, the usual one first; none for other values.

    Each letter that looks like two is read alike wherever it stands, so there are 2 ** len(SECOND_GREEK) at most.
    """
    form, swapped = _consistent_by(value)
    if not swapped:
        return []
    unsure = sorted(swapped & SECOND_GREEK.keys())
    found = [form]
    for n in range(1, len(unsure) + 1):
        found += [_consistent_by(value, frozenset(some))[0] for some in combinations(unsure, n)]
    return [*dict.fromkeys(found)]


def look(value: str) -> str:
    return consistent(value)[0]


def _safe_letter(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "L" and unicodedata.normalize("NFC", ch) == ch and _ordinary(ch) == ch


_NO_LETTERS = r"!-@\[-`{-~"
_GREEK = char_class(_safe_letter, [(0x370, 0x3FF), (0x1F00, 0x1FFF)])
#: Values that are surely in their consistent form: Latin-only or Greek-only ordinary letters without blanks.
#: The end is spelt out, since `$` also matches before a last line break; `\z` is unknown to Python's re.
CLEAN = rf"^(?:[!-~]*|[{_NO_LETTERS}{_GREEK}]*)(?![\s\S])"


def suspicious(value: Column) -> Column:
    """True for values that may not be in their consistent form; runs in the JVM. Null gives null."""
    return ~value.rlike(CLEAN)


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("readings", T.ArrayType(T.StringType()))]))
def _consistent(values: pd.Series) -> pd.DataFrame:
    pairs = per_distinct(values, lambda v: (look(v), readings(v)))
    return pd.DataFrame({"form": pairs.map(lambda p: p and p[0]), "readings": pairs.map(lambda p: p and p[1] or None)})


_consistent = _consistent.asNondeterministic()  # else the planner evaluates it once for the filter and once for the result


def unify_values(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every row of values (any columns beside `value`) whose value is not in its consistent form.

    Adds `consistent` and `status`: `form` (composition, invisible characters, blanks, letter style),
    `script` (look-alikes of another script were replaced and the result is a word of vocabulary) or
    `script_unattested` (replaced, but the vocabulary has none of the readings). vocabulary: one column `value`;
    only its own consistent values count, each once, however often it occurs.

    Null values are left out, empty ones are consistent; a value of nothing but invisible characters
    becomes the empty string. Rows are kept as often as they occur. Names beside `value` may be any but
    `consistent` and `status`. Python sees only values that the JVM filter can't clear; the rows that are left are
    written to the shared folder when this is called, and readings are looked up once per distinct value.
    """
    kept = values.columns
    inner = values.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    at = f"c{kept.index('value')}"
    done = cut(inner.where(suspicious(F.col(at))).withColumn("f", _consistent(at)).where(F.col("f.form") != F.col(at)).select(*inner.columns, "f.form", "f.readings"), "unified")
    mixed = done.where("readings is not null")
    read = mixed.select(F.col(at).alias("v"), "readings").distinct().select("v", F.posexplode("readings").alias("place", "w"))
    # a reading is a consistent form, so only such values of the vocabulary can be one; it is narrowed before it is made distinct
    words = vocabulary.select(F.col("value").alias("w")).join(small(read.select("w").distinct()), "w", "left_semi").distinct()
    attested = cut(read.join(words, "w").groupBy("v").agg(F.min_by("w", "place").alias("w")), "attested")
    settled = mixed.join(small(attested), F.col(at) == F.col("v"), "left").select(*inner.columns, F.coalesce("w", "form").alias("form"), F.when(F.col("w").isNotNull(), "script").otherwise("script_unattested").alias("status"))
    plain = done.where("readings is null").select(*inner.columns, "form", F.lit("form").alias("status"))
    return plain.unionByName(settled).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("form").alias("consistent"), "status")
