"""Text helpers as column expressions (everything stays in the JVM)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space (also the four ASCII separators), markdown and emoji character classes.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MARKDOWN = "*_`#>~"
SPEECH_MARKDOWN = "*_`#<>~"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"
WORD = r"[\p{L}\p{N}_]+"

# The four tones, the ordered aliases that lead to them, and the four certainty labels.
TONES = ("vui ve", "hao hung", "tram am", "trung tinh")
TONE_ALIASES = (
    ("happy", "vui ve"), ("cheerful", "vui ve"), ("vui", "vui ve"), ("nhe nhang", "vui ve"), ("than thien", "vui ve"),
    ("excited", "hao hung"), ("energetic", "hao hung"), ("soi noi", "hao hung"), ("sinh dong", "hao hung"),
    ("kich tinh", "hao hung"),
    ("calm", "tram am"), ("deep", "tram am"), ("warm", "tram am"), ("tram", "tram am"), ("am ap", "tram am"),
    ("nghiem tuc", "tram am"), ("sad", "tram am"), ("buon", "tram am"),
    ("neutral", "trung tinh"), ("binh thuong", "trung tinh"),
)
DEFAULT_TONE = "trung tinh"
CERTAINTY_LEVELS = ("observed_fact", "safe_inference", "creative_framing", "user_provided_fact")

# Letters that carry a Vietnamese tone or vowel mark.
VI_MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"

# Speaking rate, pitch and volume per tone.
TONE_PROSODY = {
    "vui ve": ("+5%", "+3Hz", "+0%"),
    "hao hung": ("+10%", "+6Hz", "+5%"),
    "tram am": ("-8%", "-4Hz", "-3%"),
    "trung tinh": ("+0%", "+0Hz", "+0%"),
}


def _accent_table() -> tuple[str, str]:
    """Every BMP letter whose canonical decomposition is one base character plus combining marks."""
    src, dst = [], []
    for cp in range(0xC0, 0x10000):
        ch = chr(cp)
        if ch in "đĐ":
            src.append(ch)
            dst.append("d" if ch == "đ" else "D")
            continue
        bare = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"]
        if len(bare) == 1 and bare[0] != ch:
            src.append(ch)
            dst.append(bare[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later filters and projections read as values.  (A plain projection is merged into whatever
    uses it, so a costly expression would be evaluated again for every use.)"""
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def squeeze(c: Column, drop: str = "") -> Column:
    """White space runs become one space, none at either end; characters of ``drop`` are left out in the same pass."""
    spaced = F.translate(c, WS_CHARS + drop, " " * len(WS_CHARS))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def tokens(c: Column) -> Column:
    """White-space separated tokens; an empty array for blank text."""
    return F.filter(F.split(squeeze(c), " "), lambda x: x != "")


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def count_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0))


def clean_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), EMOJI, ""), MARKDOWN)


def clean_speech_text(c: Column) -> Column:
    return squeeze(c, SPEECH_MARKDOWN)


def snippet(c: Column, n: int = 160) -> Column:
    return F.substring(squeeze(c), 1, n)


def normalize_tone(c: Column) -> Column:
    def choose(s: Column) -> Column:
        picked = None
        for needle, tone in [(t, t) for t in TONES] + list(TONE_ALIASES):
            hit = s.contains(needle)
            picked = F.when(hit, tone) if picked is None else picked.when(hit, tone)
        return picked.otherwise(DEFAULT_TONE)

    return let(squeeze(F.translate(F.lower(strip_accents(F.coalesce(c, F.lit("")))), "_-", "  ")), choose)


def normalize_certainty(c: Column) -> Column:
    s = F.lower(squeeze(F.coalesce(c, F.lit(""))))
    return F.when(s.isin(*CERTAINTY_LEVELS), s).otherwise(CERTAINTY_LEVELS[0])


def marked_share(c: Column, marked: str = VI_MARKED) -> tuple[Column, Column]:
    """(number of letters, share of them that belong to ``marked``)."""
    low = F.lower(c)
    letters = F.length(F.regexp_replace(low, r"[^\p{L}]+", ""))
    hits = F.length(low) - F.length(F.translate(low, marked, ""))
    return letters, hits / F.nullif(letters, F.lit(0))


def missing_marks(c: Column, language: Column, target: str = "vi", marked: str = VI_MARKED,
                  min_letters: int = 6, min_share: float = 0.08) -> Column:
    letters, share = marked_share(c, marked)
    return F.coalesce((language == target) & (letters >= min_letters) & (share < min_share), F.lit(False))


def truncate_words(c: Column, limit: Column) -> Column:
    """Longest token prefix within the word limit, cut back to a late punctuation mark, closed by a full stop."""
    # words are counted token by token, so a token of several words is dropped as a whole
    def prefix(toks: Column) -> Column:
        kept = F.aggregate(
            toks, F.struct(F.lit(0).alias("words"), F.lit(0).alias("kept")),
            lambda acc, w: let(acc["words"] + count_words(w), lambda n: F.struct(
                n.alias("words"), (acc["kept"] + F.when(n <= limit, 1).otherwise(0)).alias("kept"))),
            lambda acc: acc["kept"])
        return F.array_join(F.slice(toks, F.lit(1), kept), " ")

    def back_to_mark(cut: Column) -> Column:
        upto = F.regexp_extract(cut, r"(?s)^(.*[.!?…,;:])", 1)
        late = F.length(upto) >= F.greatest(F.length(cut) * F.lit(0.6), F.lit(1))
        return F.regexp_replace(F.when(late, upto).otherwise(cut), "[ ,;:-]+$", "")

    closed = lambda cut: F.when(cut.rlike("[.!?…]$"), cut).otherwise(F.concat(cut, F.lit(".")))
    return let(let(let(tokens(c), prefix), back_to_mark), closed)


def wrap_two_lines(c: Column, max_chars: int = 42) -> Column:
    """At most two lines: the longest token prefix that fits (one token at least), then everything else."""
    def fitting(toks: Column) -> Column:
        # width: characters of the first line so far; -1 once a token did not fit
        return F.aggregate(
            toks, F.struct(F.lit(0).alias("width"), F.lit(0).alias("kept")),
            lambda acc, w: F.when(acc["kept"] == 0, F.struct(F.length(w).alias("width"), F.lit(1).alias("kept")))
            .when((acc["width"] >= 0) & (acc["width"] + 1 + F.length(w) <= max_chars),
                  F.struct((acc["width"] + 1 + F.length(w)).alias("width"), (acc["kept"] + 1).alias("kept")))
            .otherwise(F.struct(F.lit(-1).alias("width"), acc["kept"].alias("kept"))),
            lambda acc: acc["kept"])

    def laid_out(toks: Column) -> Column:
        def lines(fit: Column) -> Column:
            n = F.size(toks)
            first = F.array_join(F.slice(toks, F.lit(1), fit), " ")
            rest = F.array_join(F.slice(toks, fit + 1, F.greatest(n - fit, F.lit(0))), " ")
            return F.when(fit < n, F.concat(first, F.lit("\n"), rest)).otherwise(first)
        return F.when(F.size(toks) == 0, c).otherwise(let(fitting(toks), lines))

    return let(tokens(c), laid_out)


def content_key(text: Column, voice: Column, engine: Column, prosody: Column) -> Column:
    """Identity of a speech request: 128 bits, so that different requests do not meet at any number of them."""
    return F.md5(F.concat_ws("|", text, voice, engine, prosody))


def key_label(key: Column) -> Column:
    """The short form of a content key that file names carry; not unique."""
    return F.substring(key, 1, 8)
