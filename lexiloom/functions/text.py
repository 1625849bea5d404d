"""Scalar text functions as Columns. JVM-side expressions unless the docstring says Arrow."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits, letter ranges, suffixes and stop words of the two languages, as the results require them.
BN_DIGITS = "০১২৩৪৫৬৭৮৯"
BN = "ঀ-৿"
BN_SUFFIXES = tuple(
    unicodedata.normalize("NFC", s)
    for s in (
        "গুলোর", "গুলির", "গুলো", "গুলি", "দেরকে", "দের", "টিকে", "টাকে", "টির", "টার",
        "খানা", "খানি", "টুকু", "য়ের", "েরা", "ের", "েতে", "তে", "কে", "রা", "টি", "টা", "য়", "র", "ে",
    )
)
NEGATIONS = (
    "not no never without cannot nor neither none unless না নয় নেই নাই ছাড়া বিনা ব্যতীত নি na nai nei noy chara charai bina"
)
STEM_STOP_WORDS = (
    "a an the of to in on at by for from with and or but not no is are was were be been being this that these those it its as any such "
    "shall may will can under which who whom whose what when where how if than then there their they he she his her him them you your i we "
    "our section sections act article excerpt "
    "এবং ও বা যে যা এই সেই তবে কোন কোনো করা করে হয় হবে হইবে হইলে থাকে কিংবা অথবা জন্য দ্বারা "
    "তাহার তার তাহা উক্ত এমন কেবল মধ্যে পর্যন্ত সহিত সাথে সঙ্গে ধারা অনুচ্ছেদ আইন"
)
TOKEN = f"[0-9a-z{BN}]+"


def _nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def words(listed: str) -> list[str]:
    return [_nfc(w) for w in listed.split()]


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """NFC. Arrow: Spark has no normalisation of its own; store its result instead of repeating it."""
    return text.map(lambda s: None if s is None else s if s.isascii() else _nfc(s))


def fold_digits(text: Column) -> Column:
    """Digit fold."""
    return F.translate(text, BN_DIGITS, "0123456789")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def detect_language(text: Column) -> Column:
    """Language by script ratio: bn over 0.7 of the letters of both scripts, en under 0.3, else mixed; unknown without any."""
    bn, en = count_matches(text, f"[{BN}]"), count_matches(text, "[A-Za-z]")
    ratio = bn.cast("double") / (bn + en)
    return F.when(bn + en == 0, "unknown").when(ratio > F.lit(0.7), "bn").when(ratio < F.lit(0.3), "en").otherwise("mixed")


def script_language(text: Column) -> Column:
    """Script language (question)."""
    return F.when(count_matches(text, f"[{BN}]") >= count_matches(text, "[A-Za-z]"), "bn").otherwise("en")


def script_class(text: Column) -> Column:
    """Script class (cache): one script alone, or four times as many letters of it, else mixed."""
    bn, la = count_matches(text, f"[{BN}]"), count_matches(text, "[A-Za-z]")
    return F.when(bn == 0, "latin").when(la == 0, "bn").when(bn >= 4 * la, "bn").when(la >= 4 * bn, "latin").otherwise("mixed")


def normalize_text(text: Column) -> Column:
    """Text normalise, for text that is NFC already: khanda ta, spaces, zero widths, full stop; blanks and blank lines squeezed."""
    t = F.regexp_replace(text, "ত্‍|ৎ‍", "ৎ")
    t = F.translate(t, " ৷‌​", " ।")
    t = F.regexp_replace(t, "\r\n|[\r\x0b\x0c\x1c-\x1e\u0085  ]", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, "\n{3,}", "\n\n"), F.lit(" \n"))


#: Ordered repairs of conjuncts that an old font converter broke, pattern and replacement.
LEGACY_REPAIRS = (
    ("অা", "আ"),
    ("তৃর্", "র্তৃ"),
    ("তর্ৃ", "র্তৃ"),
    ("(?<!আ)ত্ম([েিীা]?)গ", "ক্ষ$1"),
    ("তেগ", "ক্ষে"),
    ("(?<=[েং])তিগ", "ক্ষি"),
    ("(?<![্ঀ-৿])তগ(?=[ঀ-৿])", "ক্ষ"),
    ("(?<!্)তগ(?=[া্কর])", "ক্ষ"),
    ("স্ত্ম", "স্ত"),
    ("ন্ত্ম", "ন্ত"),
    ("ল([িীুূে]?)­", "ল্ল$1"),
    ("­", ""),
    ("ে্য", "্যে"),
    ("ব‍সর", "বৎসর"),
    ("ত‍(?=[^ঀ-৿]|$)", "ৎ"),
    ("(?<!্)‍(?!্)", ""),
    ("ত্‍*(?=[সকপখফশ]|$|[^ঀ-৿‍])", "ৎ"),
)


def repair_legacy(text: Column) -> Column:
    """Legacy font repair."""
    for pattern, to in LEGACY_REPAIRS:
        text = F.regexp_replace(text, pattern, to)
    return text


def extract_year(title: Column) -> Column:
    """Year extraction: the last 16xx to 20xx, null without one."""
    return F.try_element_at(F.regexp_extract_all(fold_digits(title), F.lit(r"(1[6-9][0-9][0-9]|20[0-9][0-9])")), F.lit(-1)).cast("int")


def section_refs(text: Column) -> Column:
    """Section refs: distinct numbers after section(s) or its Bangla word, by number and then by text."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:\bsections?|ধারা(?:র)?)\s+([0-9০-৯]+[A-Za-z]?)"))
    keyed = F.transform(F.array_distinct(F.transform(found, fold_digits)), lambda r: F.struct(F.regexp_replace(r, "[^0-9]", "").cast("bigint").alias("n"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda s: s["r"])


_NUMBER = r"[0-9০-৯]+(?:[A-Za-z]{1,2}(?![A-Za-z])|[ক-হ](?![ঀ-৿]))?"
SECTION_REF = re.compile(
    _nfc(rf"(?:ধারা(?:র|য়|য়ে|তে)?|উপ-?ধারা|অনুচ্ছেদ(?:ের|ে)?|sections?|sec\.?|ss?\.|article|art\.)\s*({_NUMBER})"), re.IGNORECASE
)
_CHAINED = re.compile(_nfc(rf"\s*(?:,|ও|এবং|আর|and|&|or|বা)\s*(?:ধারা\s*)?({_NUMBER})"), re.IGNORECASE)


def numbers_named(question: str, limit: int = 4) -> list[str]:
    """Section numbers that a question names, chained ones too; distinct, at most `limit` (a rule of the query language)."""
    out: dict[str, None] = {}
    for start in SECTION_REF.finditer(question):
        m: re.Match | None = start
        while m:
            out[m.group(1).translate(str.maketrans(BN_DIGITS, "0123456789")).upper()] = None
            m = _CHAINED.match(question, m.end())
    return list(out)[:limit]


@F.pandas_udf(T.ArrayType(T.StringType()))
def section_numbers(question: pd.Series) -> pd.Series:
    """Section numbers in a question. Arrow: a chain of anchored matches is no single expression."""
    return question.map(lambda q: numbers_named(q or ""))


def expand_references(question: Column, numbers: Column) -> Column:
    """Reference expansion: three spellings of each number after the question."""
    spelled = F.flatten(F.transform(numbers, lambda n: F.array(F.concat(F.lit("ধারা "), n), F.concat(F.lit("section "), n), n)))
    return F.trim(F.concat_ws(" ", question, F.array_join(F.array_distinct(spelled), " ")))


def strip_suffix(token: Column) -> Column:
    """Suffix stem: of a Bangla token of four letters or more, the first listed suffix that leaves three."""
    out = F.when((F.length(token) < 4) | ~token.rlike(f"[{BN}]"), token)
    for s in BN_SUFFIXES:
        out = out.when(token.endswith(s) & (F.length(token) - len(s) >= 3), F.left(token, F.length(token) - len(s)))
    return out.otherwise(token)


def stem_candidates(token: Column) -> Column:
    """Stem candidates: the token without each suffix that leaves three letters."""
    return F.array_compact(F.array(*(F.when(token.endswith(s) & (F.length(token) - len(s) >= 3), F.left(token, F.length(token) - len(s))) for s in BN_SUFFIXES)))


def tokens(text: Column, stem: bool = False, min_len: int = 1) -> Column:
    """Tokenise."""
    out = F.regexp_extract_all(fold_digits(F.lower(normalize_text(text))), F.lit(TOKEN), F.lit(0))
    if stem:
        out = F.transform(out, strip_suffix)
    return F.filter(out, lambda t: F.length(t) >= min_len) if min_len > 1 else out


def title_norm(text: Column) -> Column:
    """Title normalise: digits folded, lower case, punctuation to spaces, squeezed."""
    t = fold_digits(F.lower(normalize_text(text)))
    return F.trim(F.regexp_replace(F.regexp_replace(t, rf"(?U)[^\w\s{BN}]", " "), r"\s+", " "))


def slug(text: Column) -> Column:
    """Slug: lower case, other than letters and digits to -, 60 characters."""
    return F.left(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(60))


def text_key(text: Column) -> Column:
    """Text hash."""
    return F.sha1(text.cast("binary"))


def cache_path(url: Column) -> Column:
    """Cache key for a URL: the address's last 80 safe characters and eight digits of its hash."""
    tail = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^A-Za-z0-9._-]+", "_")
    return F.concat(F.right(tail, F.lit(80)), F.lit("-"), F.left(text_key(url), F.lit(8)))


def synthetic_id(name: Column, base: int, modulus: int) -> Column:
    """Synthetic act id: base + crc32(name) modulo; 900000 and 100000 for files, 950000 and 49999 for sources."""
    return F.lit(base) + F.crc32(name.cast("binary")) % modulus


def official_host(url: Column, hosts: tuple[str, ...] = ("bdlaws.minlaw.gov.bd", "www.supremecourt.gov.bd")) -> Column:
    """Official-host predicate."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/@]*@)?([^/:?#]+)", 1))
    return (host != "") & (host.isin(*hosts) | (host == "gov.bd") | host.endswith(".gov.bd"))


#: Unicode's space separators.
SPACES = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def trim_spaces(text: Column) -> Column:
    """Trimmed of every space separator, not of blanks alone. Spark's trim of given characters walks the whole text, so it is left to texts that need it."""
    edge = F.contains(F.lit(SPACES), F.left(text, F.lit(1))) | F.contains(F.lit(SPACES), F.right(text, F.lit(1)))
    return F.when(edge, F.trim(text, F.lit(SPACES))).otherwise(text)


def line_key(line: Column) -> Column:
    """Line key: trimmed, lower case letter by letter, runs of digits as #."""
    plain = F.replace(F.replace(trim_spaces(line), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))
    return F.regexp_replace(F.lower(plain), "[0-9০-৯]+", "#")


def searchable(text: Column) -> Column:
    """Searchable form."""
    return F.lower(flat(text))


def flat(text: Column) -> Column:
    """Flatten for comparison."""
    return F.trim(F.regexp_replace(normalize_text(text), r"\s+", " "))


def estimate_tokens(chars: Column) -> Column:
    """Token estimate: characters by 3.2, at least 1."""
    return F.greatest(F.floor(chars / F.lit(3.2)).cast("int"), F.lit(1))


def stems(text: Column) -> Column:
    """Content stems and the 6-char stem: distinct words without stop words, of three letters or digits alone, cut to six."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[A-Za-z0-9{BN}]+"), F.lit(0))
    lowered = F.transform(found, lambda w: fold_digits(F.lower(w)))
    stop = F.array(*(F.lit(w) for w in dict.fromkeys(words(STEM_STOP_WORDS))))
    kept = F.filter(lowered, lambda w: ~F.array_contains(stop, w) & ((F.length(w) >= 3) | w.rlike("^[0-9]+$")))
    return F.array_distinct(F.transform(kept, lambda w: F.left(w, F.lit(6))))


def share_found(want: Column, pool: Column) -> Column:
    """Share found, with prefix-tolerant membership: equal, or one begins with the other and the shorter has four letters."""
    near = lambda w, p: (p == w) | ((F.length(w) >= 4) & (p.startswith(w) | ((F.length(p) >= 4) & w.startswith(p))))
    hits = F.size(F.filter(want, lambda w: F.exists(pool, lambda p: near(w, p))))
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(hits / F.size(want))


def numbers_in(text: Column) -> Column:
    """Numbers in text: without citation marks, digits folded, commas dropped; distinct."""
    plain = fold_digits(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[0-9]{1,2}\]", " "))
    found = F.regexp_extract_all(plain, F.lit(r"(?U)(?<![\w.])\d+(?:[.,]\d+)*(?![\w])"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, ",", "")))


def question_numbers(question: Column) -> Column:
    """Numbers in a question: runs of digits without leading zeros, distinct and sorted."""
    found = F.regexp_extract_all(fold_digits(question), F.lit("[0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, "^0+(?=.)", ""))))


def negations(question: Column) -> Column:
    """Negation count: listed words, n't endings, and the Bangla past negative."""
    found = F.regexp_extract_all(F.lower(question), F.lit(rf"(?U)[\w{BN}']+"), F.lit(0))
    listed = F.array(*(F.lit(w) for w in words(NEGATIONS)))
    in_list = F.size(F.filter(found, lambda w: F.array_contains(listed, w)))
    ends = F.size(F.filter(found, lambda w: w.endswith("n't")))
    past = F.size(F.filter(found, lambda w: (F.length(w) > 3) & w.endswith("নি") & w.rlike(f"^[{BN}]")))
    return in_list + ends + past


def cache_signature(question: Column, scope: Column, topics: Column) -> Column:
    """Cache signature: all that has to be equal before two questions are compared."""
    return F.struct(
        scope.alias("scope"), script_class(question).alias("script"), question_numbers(question).alias("numbers"), negations(question).alias("negations"), F.array_sort(F.array_distinct(topics)).alias("topics")
    )


def question_norm(question: Column) -> Column:
    """Question normalise (gaps)."""
    return F.regexp_replace(F.trim(F.lower(question), F.lit(" ?।!.")), r"\s+", " ")


def utc_day(epoch: Column) -> Column:
    """UTC day of epoch seconds; null for null and 0. The session's time zone has to be UTC."""
    return F.when(epoch != 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd"))


def act_url(url: Column, act_id: Column) -> Column:
    """Official act URL."""
    return F.when(act_id.isNotNull() & url.contains("/act-"), F.concat(F.split_part(url, F.lit("/act-"), F.lit(1)), F.lit("/act-"), act_id.cast("string"), F.lit(".html")))


#: What a numbered unit of each kind of document is called, Bangla and English.
UNIT_LABELS = {
    "act": ("ধারা", "Section"),
    "rule": ("বিধি", "Rule"),
    "regulation": ("প্রবিধান", "Regulation"),
    "sro": ("অনুচ্ছেদ", "Paragraph"),
    "order": ("অনুচ্ছেদ", "Paragraph"),
    "judgment": ("পৃষ্ঠা", "Page"),
}


def unit_label(doc_type: Column, language: Column) -> Column:
    """Unit label."""
    label = lambda i: F.coalesce(F.create_map(*(F.lit(x) for k, v in UNIT_LABELS.items() for x in (k, v[i])))[F.coalesce(doc_type, F.lit("act"))], F.lit(UNIT_LABELS["act"][i]))
    return F.when(language == "bn", label(0)).otherwise(label(1))


def context_header(title: Column, chapter: Column, heading: Column, label: Column, number: Column, name: Column) -> Column:
    """Context header: act > chapter > heading > unit number: title, without what is empty."""
    part = lambda c: F.when(c != "", c)
    return F.concat_ws(" > ", title, part(chapter), part(heading), F.trim(F.concat(label, F.lit(" "), number, F.lit(": "), name)))


def join_heading(number: Column, name: Column) -> Column:
    """Heading join."""
    return F.nullif(F.concat_ws(" - ", F.nullif(number, F.lit("")), F.nullif(name, F.lit(""))), F.lit(""))


def is_omitted(text: Column, title: Column) -> Column:
    """Omitted predicate: empty, a bracketed removal, stars alone, or a title that says so."""
    t = F.trim(text)
    number = r"\s*(?:[0-9০-৯]+[A-Za-zক-হ]{0,2}\s*[।৷.:]\s*)?"
    removed = t.rlike(rf"(?isU)^{number}\[?\s*(?:Repealed|Omitted|বিলুপ্ত|রহিত)\b.{{0,200}}$")
    stars = t.rlike(rf"^{number}[\[\]\s]*\*[\s*\[\]]*$")
    named = F.trim(title).rlike(r"(?i)^\[?\s*(?:\*[\s*]*|repealed|omitted|repeal|বিলুপ্ত|রহিত)\s*\.?\s*\]?\.?$")
    return (t == "") | removed | stars | named


def citation(kind: Column, title: Column, label: Column, number: Column) -> Column:
    """Citation string."""
    return F.when(kind == "overview", title).otherwise(F.concat(title, F.lit(", "), label, F.lit(" "), number))


def judgment_citation(case: Column, division: Column, page: Column, part_of: Column, language: Column) -> Column:
    """Judgment citation."""
    name = F.concat(F.coalesce(F.nullif(case, F.lit("")), F.lit("Judgment")), F.when(division != "", F.concat(F.lit(" ("), division, F.lit(")"))).otherwise(""))
    return F.when((F.coalesce(part_of, F.lit("")) == "overview") | page.isNull() | (page == 0), name).otherwise(F.concat(name, F.when(language == "bn", ", পৃ. ").otherwise(", p. "), page.cast("string")))


def latest_amendment_year(footnotes: Column) -> Column:
    """Amendment year: the greatest of 1800 to 2100 in the notes."""
    years = F.flatten(F.transform(footnotes, lambda n: F.regexp_extract_all(n, F.lit(r"(?<![0-9০-৯])([12১২][0-9০-৯]{3})(?![0-9০-৯])"))))
    return F.array_max(F.filter(F.transform(years, lambda y: fold_digits(y).cast("int")), lambda y: y.between(1800, 2100)))


def amendment_label(amended: Column, year: Column) -> Column:
    """Amendment label."""
    return F.when(amended, F.when(year.isNull(), "amended").otherwise(F.concat(F.lit("amended (latest "), year.cast("string"), F.lit(")"))))


def exact_cache_key(fields: Column) -> Column:
    """Exact cache key of a struct."""
    return F.left(F.sha2(F.to_json(fields), 256), F.lit(32))


def strip_html(html: Column) -> Column:
    """HTML fragment text and the regular-expression form of the boilerplate strip: scripts, styles and tags out, spaces squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe|button|select|svg)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = F.regexp_replace(t, name, sign)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def model_spec(spec: Column) -> Column:
    """Model spec split: provider and model at the first colon."""
    parts = F.split(spec, ":", 2)
    return F.struct(parts[0].alias("provider"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("model"))


#: What makes a short question lean on the one before, and what sends it to the agent.
FOLLOW_UP = r"(?iU)^(and|what about|why|how|then|আর|তাহলে|সেটা|ওটা|এটা|ওই|সেই|কেন|কীভাবে|কিভাবে)\b"


def looks_like_follow_up(question: Column) -> Column:
    """Follow-up predicate."""
    q = F.trim(question)
    return q.rlike(FOLLOW_UP) | (F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) <= 4)


def prompt_lines(prompt: Column, least: int = 40) -> Column:
    """Prompt lines."""
    return F.filter(F.transform(F.split(prompt, "\n"), lambda line: F.trim(line)), lambda line: F.length(line) >= least)
