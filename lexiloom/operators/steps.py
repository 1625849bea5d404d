"""Lists inside answers: next steps, tips, and the checklist made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import guard
from lexiloom.functions import text as X
from lexiloom.operators import situations

#: The lines that head a list of steps and a list of tips.
STEPS_HEADS = (
    "what you can do", "what to do next", "what you can do next", "next steps", "steps you can take", "আপনি যা করতে পারেন", "আপনি কী করতে পারেন", "আপনার করণীয়", "করণীয়", "পরবর্তী পদক্ষেপ",
)
TIPS_HEADS = ("practical tips", "ব্যবহারিক পরামর্শ")
#: The hotline whose number marks a notice, not a tip.
NOTICE_NUMBERS = ("16430", "১৬৪৩০")
#: Tips for an answer without its own.
GENERAL_TIPS = {
    "en": (
        "Write down what happened, with dates, places and the names of anyone who saw it.",
        "Keep copies of every paper: receipts, letters, notices, agreements, photos and messages.",
        "Do not sign anything you do not understand; ask legal aid to read it with you first.",
    ),
    "bn": (
        "কী ঘটেছে তা তারিখ, স্থান ও সাক্ষীদের নামসহ লিখে রাখুন।",
        "সব কাগজের কপি রাখুন: রসিদ, চিঠি, নোটিশ, চুক্তি, ছবি ও মেসেজ।",
        "না বুঝে কিছুতে সই করবেন না; আগে লিগ্যাল এইডের কাউকে দিয়ে পড়িয়ে নিন।",
    ),
}
MOST_TIPS = 3
_LEAD, _TAIL = r"[\s*_#>`\-]*", r"[\s*_`:ঃ।.]*"
_ITEM = r"(?U)^\s*(?:[0-9০-৯]{1,2}[.)।]|[-*•‣–])\s+(.*\S)\s*$"
_HEADING = r"(?U)^\s*(?:#{1,4}\s+\S|\*\*[^*]+\*\*[:ঃ]?\s*$)"
_BLANK = r"(?U)^\s*$"
_ITEMS = "array<string>"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _first(lines: Column, holds) -> Column:
    """The place (from 0) of the first line for which holds(line, place); null where there is none."""
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull()))


def list_items(lines: Column) -> Column:
    """List parser: struct(items, used) of the list that an array of lines begins with.

    Items begin with a number or bullet; other lines go on with the item above. Blank lines are passed over. The list
    ends before the first other line that is a heading, comes after a blank line, or has no item above: the lines before
    that are an island whose items are counted by their marks. used is how many lines the list takes, 0 without one.
    Null lines give no items.
    """
    blank, item = (lambda x: x.rlike(_BLANK)), (lambda x: x.rlike(_ITEM))
    first_item = F.coalesce(_first(lines, lambda x, i: item(x)), F.size(lines))
    ends = lambda x, i: ~blank(x) & ~item(x) & (x.rlike(_HEADING) | (i < first_item) | ((i > 0) & blank(F.get(lines, i - 1))))
    island = F.slice(lines, 1, F.coalesce(_first(lines, ends), F.size(lines)))
    last = F.array_max(F.filter(F.transform(island, lambda x, i: F.when(~blank(x), i + 1)), lambda i: i.isNotNull()))
    add = lambda acc, x: (
        F.when(blank(x), acc)
        .when(item(x), F.concat(acc, F.array(F.regexp_extract(x, _ITEM, 1))))
        .otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), _strip(x)))))
    )
    found = F.aggregate(F.coalesce(island, F.array().cast(_ITEMS)), F.array().cast(_ITEMS), add)
    plain = F.transform(found, lambda x: _strip(F.regexp_replace(x, r"\*\*|__", "")))
    return F.struct(F.coalesce(plain, F.array().cast(_ITEMS)).alias("items"), F.coalesce(last, F.lit(0)).alias("used"))


def _under(lines: Column, heads: tuple[str, ...]) -> tuple[Column, Column]:
    """(place of the line that heads a list, place of the first line of what is under it)."""
    named = "|".join(X._nfc(h) for h in heads)
    head = _first(lines, lambda x, i: x.rlike(rf"(?iuU)^{_LEAD}(?:{named}){_TAIL}$"))
    return head, _first(lines, lambda x, i: (i > head) & ~x.rlike(rf"(?U)^{_TAIL}$"))


def _without(lines: Column, head: Column, after: Column) -> Column:
    """The lines before a head, bare of mark-up lines just above it, a blank one, and those from `after` on without leading blanks."""
    before = F.slice(lines, 1, head)
    kept = F.array_max(F.filter(F.transform(before, lambda x, i: F.when(~x.rlike(rf"(?U)^{_LEAD}$"), i + 1)), lambda i: i.isNotNull()))
    rest = F.slice(lines, after + 1, F.size(lines))
    begins = _first(rest, lambda x, i: ~x.rlike(_BLANK))
    end = F.when(begins.isNull(), F.array().cast(_ITEMS)).otherwise(F.slice(rest, begins + 1, F.size(rest)))
    return F.concat(F.slice(before, 1, F.coalesce(kept, F.lit(0))), F.array(F.lit("")), end)


def split_answers(answers: DataFrame, text: str = "text") -> DataFrame:
    """Steps/tips parse: answers with body (the text without its lists), steps (text, cites) and tips; no shuffle.

    The list under the first head of each kind counts; tips are looked for in what is left without the steps. Notices
    with a hotline's number are no tips, and MOST_TIPS are kept. Without a list the text stays as it is, trimmed. A null text is empty.
    """
    d = answers.withColumn("__l", F.split(X.nfc(F.coalesce(F.col(text), F.lit(""))), "\n"))
    for name, heads in (("steps", STEPS_HEADS), ("tips", TIPS_HEADS)):
        head, under = _under(F.col("__l"), heads)
        d = d.withColumns({"__h": head, "__u": under})
        d = d.withColumn("__f", list_items(F.when(F.col("__u").isNotNull(), F.slice("__l", F.col("__u") + 1, F.size("__l")))))
        there = F.coalesce(F.size("__f.items") > 0, F.lit(False))
        d = d.withColumn("__l", F.when(there, _without(F.col("__l"), F.col("__h"), F.col("__u") + F.col("__f.used"))).otherwise(F.col("__l")))
        d = d.withColumn(f"__{name}", F.when(there, F.col("__f.items")).otherwise(F.array().cast(_ITEMS)))
    cites = lambda x: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda n: n.cast("int"))))
    notice = lambda x: F.contains(x, F.lit(NOTICE_NUMBERS[0])) | F.contains(x, F.lit(NOTICE_NUMBERS[1]))
    d = d.withColumns({
        "body": _strip(F.array_join("__l", "\n")),
        "steps": F.transform("__steps", lambda x: F.struct(x.alias("text"), cites(x).alias("cites"))),
        "tips": F.slice(F.filter("__tips", lambda x: ~notice(x)), 1, MOST_TIPS),
    })
    return d.drop("__l", "__h", "__u", "__f", "__steps", "__tips")


def checklists(answers: DataFrame) -> DataFrame:
    """Next-step checklist: (query_id, lang, steps, tips, generic_tips, contacts, body) of answers (query_id, question, text, refused, general).

    Refused and empty answers have none, nor those without steps whose question asks for no advice and is about no
    situation. A general answer is not split. Tips of an answer without its own are the general ones of the question's language.
    """
    asked = answers.where(~F.coalesce("refused", F.lit(False)) & (F.coalesce("text", F.lit("")) != ""))
    questions = asked.select("query_id", "question")
    matched = situations.match_topics(questions)
    contacts = situations.help_contacts(questions, matched)
    by_question = contacts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "contact"))), lambda c: c["contact"]).alias("contacts"))
    about = matched.select("query_id").distinct().withColumn("__about", F.lit(True))
    general = F.coalesce("general", F.lit(False))
    d = split_answers(asked).join(about, "query_id", "left").join(by_question, "query_id", "left")
    none = F.array().cast(_ITEMS)
    steps = F.when(general, F.array().cast(d.schema["steps"].dataType)).otherwise(F.col("steps"))
    tips = F.when(general, none).otherwise(F.col("tips"))
    d = d.withColumns({"lang": X.script_language(F.col("question")), "steps": steps, "tips": tips})
    d = d.where((F.size("steps") > 0) | guard.request_flags(F.col("question"))["advice"] | F.coalesce("__about", F.lit(False)))
    usual = F.when(F.col("lang") == "bn", F.array(*map(F.lit, GENERAL_TIPS["bn"]))).otherwise(F.array(*map(F.lit, GENERAL_TIPS["en"])))
    generic = F.size("tips") == 0
    body = F.when((F.size("steps") > 0) | ~generic, F.col("body"))
    return d.select("query_id", "lang", "steps", F.when(generic, usual).otherwise(F.col("tips")).alias("tips"), generic.alias("generic_tips"), F.coalesce("contacts", none).alias("contacts"), body.alias("body"))
