"""Text cleaning, measuring and predicates as column expressions.

Patterns follow RE2 semantics: \\s is ASCII white space and \\b an ASCII word boundary, so both are spelled out here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and white space as a regular expression's \\s has it.
SPACE = r"\s\x0B\x85\p{Z}"
ASCII_SPACE = r"\t\n\f\r "
BEFORE_WORD, AFTER_WORD = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

# Words and signs that results depend on.
NOISE_WORDS = ("music", "applause", "laughter", "laugh", "noise", "sound", "silence", "inaudible", "掌声", "音乐", "笑声", "噪音", "静音")
CUE_WORDS = ("music", "applause", "laughter", "laugh", "inaudible", "mumbling", "cheering", "whistling", "booing", "silence", "noise", "sound", "audio")
MUSIC_SIGNS = "♪♫♬♩🎵🎶🎤🎧🎼🎹🎸🎺🎻🥁"
MUSIC_NOTES = "♪♫♬♩🎵🎶"
FILLERS = ("um", "uh", "er", "ah", "oh", "mm", "hmm", "hm", "eh")
ENTITIES = (("&gt;&gt;", ""), ("&gt;", ">"), ("&lt;&lt;", "<<"), ("&lt;", "<"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&#39;", "'"), ("&#34;", '"'), ("&#8203;", ""), ("&#8204;", ""), ("&#8205;", ""))
AUDIO_CUES = (
    "music", "applause", "laughter", "laugh", "clapping", "clap", "cheering", "cheer", "whistling", "whistle", "booing", "boo",
    "silence", "quiet", "noise", "sound", "audio", "inaudible", "mumbling", "mumble", "sighing", "sigh", "gasping", "gasp",
    "crying", "cry", "sobbing", "sob", "screaming", "scream", "shouting", "shout", "yelling", "yell", "singing", "sing",
    "humming", "hum", "buzzing", "buzz", "ringing", "ring", "beeping", "beep", "clicking", "click", "ticking", "tick",
    "background", "bgm", "sfx", "fx", "effect", "effects",
)
SENTENCE_ENDS = ".!?。！？"
DOUBLE_QUOTES = ('"', "“", "”")
ABBREVIATIONS = (
    "dr.", "mr.", "mrs.", "ms.", "prof.", "vs.", "etc.", "inc.", "ltd.", "corp.", "co.", "jr.", "sr.", "st.", "ave.",
    "blvd.", "rd.", "apt.", "no.", "vol.", "ch.", "sec.", "fig.", "pg.", "pp.", "i.e.", "e.g.", "cf.", "et.", "al.",
)
PROPER_NOUNS = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Andrew", "Huberman", "OpenAI", "ChatGPT", "YouTube")


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{SPACE}]+", ""), f"[{SPACE}]+$", "")


def fields(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def one_of(words) -> str:
    return "|".join(words)


def clean_speech(text: Column) -> Column:
    """Text to be spoken: noise in parentheses, signs and dashes go, white space collapses."""
    out = F.regexp_replace(text, f"(?i)[(（][^()（）]*({one_of(NOISE_WORDS)})[^()（）]*[)）]", "")
    for sign in ("&", "®", "™", "©", "——", "--"):
        out = F.replace(out, F.lit(sign), F.lit(""))
    return trim(F.regexp_replace(out, f"[{ASCII_SPACE}]+", " "))


def silence_only(text: Column) -> Column:
    return clean_speech(text) == ""


def clean_caption(text: Column) -> Column:
    """A caption line without bracketed cues, music signs, speaker marks and a leading filler, entities decoded.

    The filler has no word boundary after it, so a word that begins like one loses its beginning. Entities are replaced
    in the order stated, longer ones first.
    """
    out = F.regexp_replace(text, r"\[[^\]]*\]", "")
    out = F.regexp_replace(out, rf"\([^)]*(?i:{one_of(CUE_WORDS)})[^)]*\)", "")
    out = F.regexp_replace(out, f"[{MUSIC_SIGNS}]", "")
    out = F.replace(out, F.lit(">>"), F.lit(""))
    out = F.regexp_replace(out, f"(?i)^[{ASCII_SPACE}]*({one_of(FILLERS)})[{ASCII_SPACE}]*[,，]?[{ASCII_SPACE}]*", "")
    out = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, out)
    return F.regexp_replace(trim(out), f"[{ASCII_SPACE}]+", " ")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def unless_plain(text: Column, value: Column) -> Column:
    """The value, but the text itself where it has ASCII letters and digits alone: most words need no further pattern."""
    return F.when(text.rlike("^[A-Za-z0-9]*$"), text).otherwise(value)


def trim_punctuation(text: Column) -> Column:
    """Without Unicode punctuation at either end."""
    return unless_plain(text, F.regexp_replace(text, r"^\p{P}+|\p{P}+$", ""))


def base_text(text: Column) -> Column:
    """Without punctuation, symbols and white space."""
    return unless_plain(text, F.regexp_replace(text, rf"[\p{{P}}\p{{S}}{SPACE}]", ""))


def recognizable(text: Column) -> Column:
    """Latin, Han, Hangul and kana letters and numbers only."""
    return unless_plain(text, F.regexp_replace(text, r"[^\p{IsLatin}\p{N}\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]", ""))


def plain_words(text: Column) -> Column:
    """Words of letters, numbers and apostrophes."""
    return fields(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{ASCII_SPACE}']+", " "))


def effective_chars(text: Column) -> Column:
    """Letters and numbers, in code points."""
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def sentences(text: Column, marks: str = r".!?。！？；\n\r") -> Column:
    """Parts that end with a run of marks, trimmed, empty ones left out."""
    parts = F.split(F.regexp_replace(text, f"([{marks}]+)", "$1\ue001"), "\ue001")
    return F.filter(F.transform(parts, trim), lambda p: p != "")


def clauses(text: Column) -> Column:
    """As sentences, cut at commas and semicolons as well."""
    return sentences(text, r".!?；。！？,，;\n\r")


def display_width(text: Column) -> Column:
    """Two for a Han character, one for any other."""
    return F.char_length(text) + F.char_length(F.regexp_replace(text, r"[^\p{IsHan}]", ""))


def weighted_length(text: Column) -> Column:
    """Han, kana and full-width forms count 1.75, Hangul 1.5, others 1."""
    count = lambda cls: F.char_length(F.regexp_replace(text, f"[^{cls}]", ""))
    wide = count(r"一-鿿぀-ゟ゠-ヿ＀-￯")
    return F.char_length(text) + wide * 0.75 + count(r"가-힯") * 0.5


def code_fences_removed(text: Column) -> Column:
    """Without the lines that open or close a code block."""
    return trim(F.regexp_replace(text, r"(?m)^```[a-zA-Z]*[\t\f\r ]*$\n?", ""))


def likely_repeat(text: Column) -> Column:
    """Several words, or over 20 bytes."""
    return (text != "") & (F.contains(text, F.lit(" ")) | (F.octet_length(text) > 20))


def pure_punctuation(text: Column) -> Column:
    return text.rlike(r"^[^\p{L}\p{N}]+$")


def audio_cue(text: Column) -> Column:
    return F.lower(text).isin(*AUDIO_CUES) | text.rlike(f"[{MUSIC_NOTES}]")


def single_word(text: Column) -> Column:
    """One word of 1 to 15 bytes that is neither an audio cue nor punctuation alone."""
    return (text != "") & ~F.contains(text, F.lit(" ")) & (F.octet_length(text) <= 15) & ~F.lower(text).isin(*AUDIO_CUES) & (text.rlike("^[A-Za-z0-9]*$") | ~(text.rlike(f"[{MUSIC_NOTES}]") | pure_punctuation(text)))


def lone_quote(text: Column) -> Column:
    return trim(text).isin(*DOUBLE_QUOTES)


def ends_sentence(text: Column) -> Column:
    return trim(text).rlike("[.!?。！？…]$")


def ends_sentence_or_quote(text: Column) -> Column:
    """Ends with a sentence mark, also before one closing quote."""
    return text.rlike(f"[{SENTENCE_ENDS}][\"“”」』]?$")


def is_number(text: Column) -> Column:
    return text.rlike(r"^[+-]?[0-9]+$")


TIME_LINE = r"[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} --> [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}"


def subtitle_text(line: Column) -> Column:
    """A line that is neither empty, a number nor a time line."""
    return (line != "") & ~is_number(line) & ~line.rlike(TIME_LINE)


def special_content(text: Column) -> Column:
    """Mostly other than ASCII letters (against bytes), or with a known name."""
    t = trim(text)
    other = F.char_length(F.regexp_replace(t, "[a-zA-Z]", ""))
    names = reduce(lambda a, b: a | b, (F.contains(F.lower(t), F.lit(n.lower())) for n in PROPER_NOUNS))
    return (t != "") & ((other > F.octet_length(t) * 0.5) | names)


def target_script(text: Column, lang: Column) -> Column:
    """Whether a text has letters of its language: Han for zh, kana or Han for ja, half its bytes Latin for en."""
    latin = F.char_length(F.regexp_replace(text, "[^a-zA-Z]", "")) >= F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) * 0.5
    return (
        F.when(lang.isin("zh_cn", "zh_tw"), text.rlike(r"[一-鿿]"))
        .when(lang == "en", latin)
        .when(lang == "ja", text.rlike(r"[぀-ゟ゠-ヿ一-鿿]"))
        .otherwise(F.lit(True))
    )


def valid_translation(origin: Column, translated: Column, lang: Column) -> Column:
    """Not empty, not the origin unless special, in the right script, and of 0.3 to 3 times its bytes unless short."""
    o, t = trim(origin), trim(translated)
    a, b = F.octet_length(o), F.octet_length(t)
    sized = ((b >= a * 0.3) & (b <= a * 3.0)) | (a < 10)
    return F.when(t == "", False).when(o == t, special_content(origin)).otherwise(target_script(translated, lang) & sized)


def first_words(text: Column, n: int = 3) -> Column:
    """The first n words in lower case, null with fewer."""
    found = F.slice(fields(F.lower(text)), 1, n)
    return F.when(F.size(found) == n, found)


def text_match(a: Column, b: Column) -> Column:
    """Either contains the other, or their first three words are equal, in lower case; an empty text matches nothing."""
    heads = F.coalesce(first_words(a) == first_words(b), F.lit(False))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | heads)


# Signs that go, and pairs of signs whose content stays as it is.
SINGLE_SIGNS = ",.;:!?~，、。！？；：…"
SIGN_PAIRS = ("「」", "『』", "“”", "‘’", "《》", "<>", "【】", "〔〕", "()", "[]", "{}")


def spaced_signs(text: Column) -> Column:
    """Single signs go at the end and are one space elsewhere, but for decimal points and within a pair, even an open one."""
    esc = lambda c: "\\" + c if c in "[](){}" else c
    pairs = one_of(f"{esc(a)}[^{esc(b)}]*{esc(b)}?" for a, b in SIGN_PAIRS)
    opening = "".join(esc(a) for a, _ in SIGN_PAIRS)
    bare = F.regexp_replace(text, f"[{SINGLE_SIGNS}{SPACE}]+$", "")
    tokens = F.regexp_extract_all(bare, F.lit(f"({pairs}|\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*|[{SINGLE_SIGNS}]|[^{opening}{SINGLE_SIGNS}\\p{{Nd}}]+)"))
    after = lambda out, t: F.when(~t.rlike(f"^[{SINGLE_SIGNS}]$"), F.concat(out, t)).when(out.rlike(f"(^|[{SPACE}])$"), out).otherwise(F.concat(out, F.lit(" ")))
    return trim(F.aggregate(tokens, F.lit(""), after))


# Names that a file system keeps for devices.
RESERVED = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "LPT1", "LPT2")


def safe_name(text: Column) -> Column:
    """A path name: dots, slashes, brackets, question marks and null bytes as underscores, never empty or reserved."""
    out = trim(F.regexp_replace(F.replace(text, F.lit("."), F.lit("_")), r"[/\[\]\x00?]", "_"))
    return F.when(out == "", "unnamed").when(F.upper(out).isin(*RESERVED), F.concat(F.lit("_"), out)).otherwise(out)


def ass_colour(colour: Column) -> Column:
    """#RRGGBB or #RRGGBBAA as &HAABBGGRR with inverted alpha."""
    alpha = F.when(F.char_length(colour) == 9, F.lpad(F.hex(255 - F.conv(F.substring(colour, 8, 2), 16, 10).cast("int")), 2, "0")).otherwise("00")
    part = lambda i: F.upper(F.substring(colour, i, 2))
    return F.concat(F.lit("&H"), alpha, part(6), part(4), part(2))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Each {{key}} replaced."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{{" + kv[0] + "}}"), kv[1]), values.items(), F.lit(template))


#: Characters of an address that the name of its task keeps.
TASK_CHARACTERS = 16


def task_name(address: Column) -> Column:
    """A name for the task of an address: its parameter v, else the last part of its path, else all of it, made safe.

    Blanks go, 16 characters stay, and where nothing is left it is "task". Percent signs are not decoded.
    """
    whole = trim(F.coalesce(address, F.lit("")))
    asked = F.regexp_extract(whole, r"(?s)^[^?#]*\?(?:[^#]*&)?v=([^&#]*)", 1)
    has = whole.rlike(r"(?s)^[^?#]*\?(?:[^#]*&)?v=")
    path = F.regexp_extract(whole, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    last = F.element_at(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), -1)
    found = F.when(has, asked).when(path != "", last).otherwise(whole)
    short = F.substring(F.replace(found, F.lit(" "), F.lit("")), 1, TASK_CHARACTERS)
    safe = safe_name(F.when(trim(short) == "", F.lit("task")).otherwise(short))
    return F.when(safe == "", F.lit("task")).otherwise(safe)


def task_id(address: Column, key: Column) -> Column:
    """task_name with a suffix of eight hexadecimal digits that the key fixes, so that a task run again keeps its id."""
    return F.concat(task_name(address), F.lit("_"), F.substring(F.sha2(key.cast("string"), 256), 1, 8))
