"""Which act and which section a question names: title stems, aliases, topics, lookups, synonyms, transliteration."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import text as X
from lexiloom.operators import situations
from lexiloom.operators.contain import containment_join
from lexiloom.session import materialized

#: Fixed value: words of titles that amend or repeal.
AMENDING = "(?i)সংশোধন|amendment|repeal|রহিতকরণ"
#: Everyday names of acts, and a phrase of the official title of each.
ACT_ALIASES = {
    "দণ্ডবিধি": "penal code", "দন্ডবিধি": "penal code", "penal code": "penal code",
    "ফৌজদারী কার্যবিধি": "code of criminal procedure", "ফৌজদারি কার্যবিধি": "code of criminal procedure",
    "crpc": "code of criminal procedure", "cr.p.c": "code of criminal procedure",
    "দেওয়ানী কার্যবিধি": "code of civil procedure", "দেওয়ানি কার্যবিধি": "code of civil procedure", "cpc": "code of civil procedure",
    "সাক্ষ্য আইন": "evidence act", "evidence act": "evidence act", "চুক্তি আইন": "contract act", "contract act": "contract act",
    "তামাদি আইন": "limitation act", "limitation act": "limitation act", "সম্পত্তি হস্তান্তর আইন": "transfer of property act",
    "সংবিধান": "constitution", "constitution": "constitution", "শ্রম আইন": "শ্রম আইন", "labour act": "শ্রম আইন",
}
#: Terms of one meaning.
SYNONYMS = (
    ("উচ্ছেদ", "বেদখল", "eviction", "evict"), ("ভাড়া", "rent", "ভাড়াটিয়া", "tenant"), ("শাস্তি", "দণ্ড", "punishment", "penalty"), ("জরিমানা", "fine", "অর্থদণ্ড"),
    ("কারাদণ্ড", "imprisonment", "জেল"), ("হত্যা", "খুন", "murder", "homicide"), ("অবহেলা", "negligence", "negligent"), ("চুক্তি", "contract", "agreement"),
    ("নিবন্ধন", "registration", "register", "নথিভুক্ত"), ("নোটিশ", "notice", "বিজ্ঞপ্তি"), ("আবেদন", "application", "দরখাস্ত"), ("কর্মচারী", "employee", "শ্রমিক", "worker"),
    ("মালিক", "employer", "owner", "নিয়োগকর্তা"), ("বীমা", "insurance", "বীমাকারী", "insurer"), ("সংজ্ঞা", "definition", "means", "অর্থ"),
    ("আদালত", "court", "ট্রাইব্যুনাল", "tribunal"), ("অপরাধ", "offence", "offense", "crime"), ("ক্ষতিপূরণ", "compensation", "damages"),
    ("উত্তরাধিকার", "inheritance", "succession"), ("ছুটি", "leave", "holiday"), ("চুরি", "theft", "steal", "stolen"), ("চেক", "cheque"),
    ("ডিজঅনার", "dishonour", "dishonoured", "bounce", "bounced"), ("অপহরণ", "kidnapping", "kidnap", "abduction"), ("ধর্ষণ", "rape"), ("যৌতুক", "dowry"),
    ("জালিয়াতি", "forgery", "forged"), ("প্রতারণা", "cheating", "fraud"), ("ঘুষ", "bribe", "bribery", "gratification"), ("জামিন", "bail"),
    ("গ্রেপ্তার", "গ্রেফতার", "arrest"), ("পরোয়ানা", "warrant"), ("সাক্ষী", "witness"), ("স্বীকারোক্তি", "confession"), ("তালাক", "divorce"), ("ভরণপোষণ", "maintenance"),
    ("মাতৃত্ব", "প্রসূতি", "maternity"), ("ভোক্তা", "consumer"), ("আত্মহত্যা", "suicide"), ("মানহানি", "defamation", "defame", "defamatory", "libel", "slander"),
    ("জমি", "ভূমি", "land"), ("মজুরি", "বেতন", "wage", "wages", "salary"), ("বকেয়া", "arrears", "unpaid"),
    ("বরখাস্ত", "ছাঁটাই", "dismissal", "dismissed", "termination", "retrenchment"), ("ত্রুটিপূর্ণ", "defective", "faulty"),
    ("সাইবার", "cyber", "অনলাইন", "online", "ফেসবুক", "facebook"),
)
#: Title of the act that governs a word's subject.
TOPIC_ACTS = {
    "consumer": "ভোক্তা-অধিকার সংরক্ষণ আইন", "ভোক্তা": "ভোক্তা-অধিকার সংরক্ষণ আইন", "defamation": "Penal Code defamation", "মানহানি": "Penal Code defamation",
    "wage": "বাংলাদেশ শ্রম আইন মজুরি পরিশোধ", "wages": "বাংলাদেশ শ্রম আইন মজুরি পরিশোধ", "salary": "বাংলাদেশ শ্রম আইন মজুরি পরিশোধ",
    "মজুরি": "বাংলাদেশ শ্রম আইন মজুরি পরিশোধ", "বেতন": "বাংলাদেশ শ্রম আইন মজুরি পরিশোধ", "cyber": "সাইবার সুরক্ষা আইন", "সাইবার": "সাইবার সুরক্ষা আইন",
    "dowry": "যৌতুক নিরোধ আইন", "যৌতুক": "যৌতুক নিরোধ আইন", "cheque": "Negotiable Instruments Act", "চেক": "Negotiable Instruments Act",
}
#: Words of romanised questions, sounds of other words (longest first), and words of plain English.
ROMAN = {
    "dhara": "ধারা", "dhaara": "ধারা", "upodhara": "উপ-ধারা", "ain": "আইন", "aain": "আইন", "bidhi": "বিধি", "adhyay": "অধ্যায়", "tofsil": "তফসিল", "ordinance": "অধ্যাদেশ",
    "ki": "কী", "kee": "কী", "kono": "কোন", "kothay": "কোথায়", "kobe": "কবে", "keno": "কেন", "kivabe": "কীভাবে", "kibhabe": "কীভাবে", "kto": "কত", "koto": "কত",
    "kotodin": "কত দিন", "ache": "আছে", "bole": "বলে", "hoy": "হয়", "hobe": "হবে", "korte": "করতে", "kora": "করা", "jonno": "জন্য", "songjha": "সংজ্ঞা", "songgya": "সংজ্ঞা",
    "shasti": "শাস্তি", "sasti": "শাস্তি", "danda": "দণ্ড", "jorimana": "জরিমানা", "bhara": "ভাড়া", "vara": "ভাড়া", "barirmalik": "বাড়িওয়ালা", "malik": "মালিক",
    "bharatiya": "ভাড়াটিয়া", "bhatatiya": "ভাড়াটিয়া", "uchched": "উচ্ছেদ", "chukti": "চুক্তি", "notish": "নোটিশ", "notice": "নোটিশ", "abedon": "আবেদন",
    "nibondhon": "নিবন্ধন", "registration": "নিবন্ধন", "bima": "বীমা", "polisi": "পলিসি", "chakri": "চাকরি", "sromik": "শ্রমিক", "kormochari": "কর্মচারী", "beton": "বেতন",
    "hottya": "হত্যা", "khun": "খুন", "chuti": "ছুটি", "adalot": "আদালত", "mamla": "মামলা", "odhikar": "অধিকার", "obohela": "অবহেলা", "mrittu": "মৃত্যু", "somoy": "সময়",
}
SOUNDS = {
    "kkh": "ক্ষ", "chh": "ছ", "bh": "ভ", "ch": "চ", "dh": "ধ", "gh": "ঘ", "jh": "ঝ", "kh": "খ", "ph": "ফ", "sh": "শ", "th": "থ", "ng": "ং", "aa": "া", "ee": "ী", "oo": "ু",
    "ou": "ৌ", "oi": "ৈ", "a": "া", "i": "ি", "u": "ু", "e": "ে", "o": "ো", "b": "ব", "c": "ক", "d": "দ", "f": "ফ", "g": "গ", "h": "হ", "j": "জ", "k": "ক", "l": "ল", "m": "ম",
    "n": "ন", "p": "প", "q": "ক", "r": "র", "s": "স", "t": "ত", "v": "ভ", "w": "ও", "x": "ক্স", "y": "য়", "z": "জ",
}
ENGLISH = (
    "what which who when where why how is are the of for section act law punishment does do can must shall under penalty fine court notice rent tenant employer contract insurance"
).split()
#: Words of one who tells of themselves, and of a comparison.
COLLOQUIAL = r"(?iU)\b(?:i|me|my|mine|i'm|i've|someone|somebody)\b|আমি|আমার|আমাকে|আমায়|আমাদের|কেউ"
COMPARATIVE = r"(?iU)পার্থক্য|তুলনা|difference|compare|versus|\bvs\b"
_REF = "(?i)" + X.SECTION_REF.pattern
#: Fusion weights (dense, lexical) by the class of a question.
ROUTE_WEIGHTS = {"exact_ref": (0.6, 1.6), "comparative": (1.0, 1.0), "conceptual": (1.3, 0.8)}


def query_class(question: Column) -> Column:
    """Query class."""
    return F.when(question.rlike(_REF), "exact_ref").when(question.rlike(COMPARATIVE), "comparative").otherwise("conceptual")


def adaptive_weights(question: Column) -> Column:
    """Adaptive weights: struct(dense, lexical) of the question's class."""
    c = query_class(question)
    pick = lambda i: F.create_map(*(F.lit(x) for k, v in ROUTE_WEIGHTS.items() for x in (k, v[i])))[c]
    return F.struct(pick(0).alias("dense"), pick(1).alias("lexical"))


def is_colloquial(question: Column) -> Column:
    """Colloquial predicate."""
    return question.rlike(COLLOQUIAL) & ~question.rlike(_REF)


def looks_romanised(question: Column) -> Column:
    """Romanised predicate: known romanised words, and more of them than plain English ones."""
    found = F.transform(F.regexp_extract_all(question, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    count = lambda listed: F.size(F.filter(found, lambda t: F.array_contains(F.array(*map(F.lit, listed)), t)))
    bangla, english = count(list(ROMAN)), count(ENGLISH)
    return (bangla > 0) & ~((english > 0) & (english >= bangla))


_SOUND = re.compile("|".join(map(re.escape, SOUNDS)))


def to_bangla(question: str, phonetic: bool = True) -> str:
    def word(m: re.Match) -> str:
        low = m[0].lower()
        if low in ROMAN:
            return ROMAN[low]
        return m[0] if low in ENGLISH or not phonetic else _SOUND.sub(lambda s: SOUNDS[s[0]], low)

    return re.sub("[A-Za-z]+", word, question)


@F.pandas_udf(T.StringType())
def transliterate(question: pd.Series) -> pd.Series:
    """Transliterate, phonetic map included. Arrow: words are replaced one by one."""
    return question.map(lambda q: None if q is None else to_bangla(q))


@F.pandas_udf(T.StringType())
def transliterate_known(question: pd.Series) -> pd.Series:
    return question.map(lambda q: None if q is None else to_bangla(q, phonetic=False))


def romanised_variant(question: Column) -> Column:
    """Romanised variant: null unless the question is romanised and changes."""
    return F.when(looks_romanised(question), F.nullif(transliterate_known(question), question))


def synonym_table(spark: SparkSession) -> DataFrame:
    """(term, alternate) of all groups."""
    pairs = sorted({(X._nfc(a.lower()), X._nfc(b)) for g in SYNONYMS for a in g for b in g})
    return spark.createDataFrame(pairs, "term string, alternate string")


def expand_synonyms(questions: DataFrame, most: int = 6) -> DataFrame:
    """Synonym expansion of (query_id, question): up to `most` alternates and two act titles after the question.

    Words count as they stand and without each suffix. Alternates are in the order of term and alternate (a total
    order, so results repeat).
    """
    spark = questions.sparkSession
    found = F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(rf"(?U)[\w{X.BN}]+"), F.lit(0)), F.lower))
    stems = F.array_distinct(F.concat(found, F.flatten(F.transform(found, X.stem_candidates))))
    q = questions.select("query_id", "question", stems.alias("present"))
    w = q.select("query_id", "question", "present", F.explode("present").alias("term"))
    alts = w.join(F.broadcast(synonym_table(spark)), "term").where(~F.array_contains("present", F.lower("alternate")))
    alts = alts.groupBy("query_id", "alternate").agg(F.min("term").alias("term")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "alternate"))).alias("a"))
    acts = spark.createDataFrame(sorted({(X._nfc(k.lower()), X._nfc(v)) for k, v in TOPIC_ACTS.items()}), "term string, title string")
    titles = w.join(F.broadcast(acts), "term").where(~F.contains("question", "title")).groupBy("query_id", "title").agg(F.min("term").alias("term"))
    titles = titles.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "title"))).alias("t"))
    none = F.array().cast("array<string>")
    d = questions.join(alts, "query_id", "left").join(titles, "query_id", "left")
    added = F.concat(F.coalesce(F.slice(F.transform("a", lambda s: s["alternate"]), 1, most), none), F.coalesce(F.slice(F.transform("t", lambda s: s["title"]), 1, 2), none))
    return d.select("query_id", F.trim(F.concat_ws(" ", "question", F.array_join(added, " "))).alias("expanded"))


def title_stems(acts: DataFrame, least: int = 6) -> DataFrame:
    """Title-stem index build: (stem, act_id) of acts (act_id, title, repealed); in force first, then the latest year."""
    bare = F.regexp_replace("title", r"[,\s]*[(\[]?\s*[0-9০-৯]{4}\s*[)\]]?\s*$", "")
    s = acts.withColumn("stem", F.regexp_replace(X.title_norm(bare), "^the ", "")).where((F.length("stem") >= least) & ~F.col("stem").rlike(AMENDING))
    w = Window.partitionBy("stem").orderBy("repealed", F.coalesce(X.extract_year(F.col("title")), F.lit(0)).desc(), "act_id")
    return s.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("stem", "act_id")


def principal_act(acts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Principal act and act-title containment: of the titles that contain a phrase, in force, not amending, shortest. phrases has (phrase)."""
    j = containment_join(acts.withColumn("__norm", X.title_norm(F.col("title"))), "__norm", phrases.select("phrase").distinct(), "phrase").drop("__norm")
    w = Window.partitionBy("phrase").orderBy("repealed", F.col("title").rlike(AMENDING), F.length("title"), "act_id")
    return j.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("phrase", "act_id")


def resolve_acts(questions: DataFrame, acts: DataFrame, most: int = 3) -> DataFrame:
    """Act title match: (query_id, act_id, place). Longest stems first, a stem inside one already found doesn't count again;
    aliases only where no title is named. Questions meet stems on the stem's rarest piece, see containment_join."""
    q = questions.select("query_id", X.title_norm(F.col("question")).alias("q"))
    hits = materialized(containment_join(q, "q", title_stems(acts), "stem"), "titles")
    longer = hits.alias("a").join(hits.alias("b"), F.expr("a.query_id = b.query_id and length(b.stem) > length(a.stem) and contains(b.stem, a.stem) and not contains(replace(a.q, b.stem, ' '), a.stem)"), "left_anti")
    titled = longer.select("query_id", "act_id", (-F.length("stem")).alias("at"), F.col("stem").alias("tie"))
    aliases = questions.sparkSession.createDataFrame([(X._nfc(k), X._nfc(v), i) for i, (k, v) in enumerate(ACT_ALIASES.items())], "alias string, phrase string, at int")
    known = aliases.select("alias", "at", X.title_norm(F.col("alias")).alias("a"), F.col("phrase").alias("p")).join(principal_act(acts, aliases.select("phrase").distinct()), F.col("p") == F.col("phrase"))
    named = q.join(titled, "query_id", "left_anti").join(F.broadcast(known), F.expr(rf"rlike(q, concat('(?U)(?<![\\w{X.BN}])\\Q', a, '\\E'))"))
    both = titled.unionByName(named.select("query_id", "act_id", "at", F.col("alias").alias("tie")))
    best = both.groupBy("query_id", "act_id").agg(F.min(F.struct("at", "tie")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "act_id")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "act_id", "place")


def lookup_sections(named: DataFrame, sections: DataFrame, most: int = 3) -> DataFrame:
    """Section lookup: (query_id, doc, place) of named (query_id, act_id, number) in sections (act_id, number, doc, part); first parts first."""
    j = named.withColumn("number", F.upper("number")).join(sections.withColumn("number", F.upper("number")), ["act_id", "number"])
    w = Window.partitionBy("query_id", "act_id", "number").orderBy("part", "doc")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "act_id", "number", "doc", "place")


def follow_references(sections: DataFrame, most: int = 3) -> DataFrame:
    """Reference following: one hop from each section by its refs to sections of the same act, and by act_refs to overviews.

    Of the sections with the same act and number only the first most + 1 by id can be among a section's first `most` (one may be
    the section itself), so no more of them meet the references, however many there are.
    """
    target = _first(sections.select("act_id", F.upper("number").alias("number"), F.col("doc").alias("to")), ["act_id", "number"], most + 1, most)
    same = sections.select("doc", "act_id", F.posexplode("refs").alias("at", "number")).withColumn("number", F.upper("number")).join(target, ["act_id", "number"]).where("doc <> to")
    over = _first(sections.where("kind = 'overview'").select("act_id", F.col("doc").alias("to")), ["act_id"], most, most)
    other = sections.select("doc", F.posexplode("act_refs").alias("at", "act_id")).join(over, "act_id")
    rows = same.select("doc", "to", "at", F.lit("section").alias("kind")).unionByName(other.select("doc", "to", "at", F.lit("act").alias("kind")))
    w = Window.partitionBy("doc", "kind").orderBy("at", "to")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def _first(targets: DataFrame, keys: list[str], ids: int, copies: int) -> DataFrame:
    """Of targets (keys, to) the rows with the `ids` least different `to` of each key, `copies` of each at most."""
    counted = targets.groupBy(*keys, "to").agg(F.count("*").alias("__n"))
    kept = counted.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("to"))).where(F.col("__i") <= ids)
    return kept.select(*keys, "to", F.explode(F.sequence(F.lit(1).cast("long"), F.least("__n", F.lit(copies)))).alias("__c")).drop("__c")


def fuzzy_acts(queries: DataFrame, acts: DataFrame, most: int = 5) -> DataFrame:
    """Fuzzy act finder: score is how many words of three letters or more of the query a title contains, each as often as it is
    there; everyday names bring in the words of the official title. Best first, then greater id, then title."""
    asked = X.nfc(F.lower(F.col("question")))
    phrases = [F.when(F.contains(asked, F.lit(X._nfc(alias))), F.lit(X._nfc(phrase))) for alias, phrase in ACT_ALIASES.items()]
    q = F.concat_ws(" ", asked, *phrases)
    words = F.filter(F.split(q, r"\s+"), lambda x: F.length(x) > 2)
    w = queries.select("query_id", F.explode(words).alias("word"))
    t = acts.select("act_id", "title", F.lower("title").alias("low"))
    hits = containment_join(t, "low", w.select("word").distinct(), "word").join(w, "word").groupBy("query_id", "act_id", "title").agg(F.count("*").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("act_id").desc(), F.col("title").desc())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def match_topics(questions: DataFrame) -> DataFrame:
    """Topic match: see situations.match_topics."""
    return situations.match_topics(questions)


def topic_sections(matched: DataFrame, acts: DataFrame, sections: DataFrame) -> DataFrame:
    """Topic to sections join: see situations.topic_sections."""
    return situations.topic_sections(matched, acts, sections, principal_act)


def act_listing(queries: DataFrame, acts: DataFrame, most: int = 5) -> DataFrame:
    """Act listing: (query_id, listing), a line for each act of the fuzzy finder, best first, or that none matches."""
    found = fuzzy_acts(queries, acts, most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "act_id", "title"))).alias("l"))
    lines = F.transform("l", lambda a: F.concat(F.lit("act_id "), a["act_id"].cast("string"), F.lit(": "), a["title"]))
    nothing = F.concat(F.lit("No act in the corpus matches '"), F.col("question"), F.lit("'."))
    return queries.join(found, "query_id", "left").select("query_id", F.coalesce(F.array_join(lines, "\n"), nothing).alias("listing"))


def overviews(acts: DataFrame, sections: DataFrame) -> DataFrame:
    """Overview lookup: (query_id, act_id, doc) of acts (query_id, act_id): the overview chunk of each, the least where there are several."""
    own = sections.where("kind = 'overview'").groupBy("act_id").agg(F.min("doc").alias("doc"))
    return acts.join(own, "act_id").select("query_id", "act_id", "doc")


def compare_sections(asked: DataFrame, sections: DataFrame, most: int = 3) -> DataFrame:
    """Side-by-side compare: (query_id, side, doc, place) of asked (query_id, act_id, a, b): first parts of both sections, a before b."""
    sides = asked.select("query_id", "act_id", F.posexplode(F.array("a", "b")).alias("side", "number"))
    keyed = sides.select(F.struct("query_id", "side").alias("query_id"), "act_id", "number")
    return lookup_sections(keyed, sections, most).select("query_id.query_id", "query_id.side", "doc", "place")


def section_or_fallback(asked: DataFrame, evidence: DataFrame, sections: DataFrame, most: int = 3) -> DataFrame:
    """Agent section lookup with fallback act: (query_id, act_id, doc, place) of asked (query_id, act_id, number).

    Where the act asked for has no such section, the first act of the evidence (query_id, act_id, at) that has it is taken. The
    act asked for comes before all of these, so one lookup finds either.
    """
    own = asked.select("query_id", "act_id", "number", F.lit(-1).cast("long").alias("at"))
    others = evidence.groupBy("query_id", "act_id").agg(F.min("at").cast("long").alias("at")).join(asked.select("query_id", "number"), "query_id").select("query_id", "act_id", "number", "at")
    tried = own.unionByName(others).withColumn("number", F.upper("number"))
    j = tried.join(sections.withColumn("number", F.upper("number")), ["act_id", "number"])
    first = F.min("at").over(Window.partitionBy("query_id", "number"))
    w = Window.partitionBy("query_id", "number").orderBy("part", "doc")
    j = j.withColumn("__f", first).where("at = __f").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return j.select("query_id", "act_id", "doc", "place")


def topic_report(acts: DataFrame, sections: DataFrame) -> DataFrame:
    """Topic report: (topic, law, act_id, title, number, doc) of every law and section of every topic, null where the corpus lacks it."""
    spark = acts.sparkSession
    numbers = [(name, i, n) for name, laws in situations.TOPIC_LAWS.items() for i, (_, _, listed) in enumerate(laws) for n in (listed or (None,))]
    rows = spark.createDataFrame(numbers, "topic string, law int, number string")
    known = situations.topic_acts(spark, acts, principal_act).join(acts.select("act_id", "title"), "act_id")
    first = sections.groupBy("act_id", F.upper("number").alias("number")).agg(F.min_by("doc", F.struct("part", "doc")).alias("doc"))
    return rows.join(known, ["topic", "law"], "left").join(first, ["act_id", "number"], "left").select("topic", "law", "act_id", "title", "number", "doc")
