"""Document review: detectors, the merge of their findings, and the application of accepted changes.

Detectors are rules where the reviewed product calls a model; a model's replies
enter by functions.text.json_records and take the same way from there. They
look at whole texts unless a window is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import first_of, fixed, paragraphs, replace_first
from marlstone.operators.passages import PASSES, parts_of
from marlstone.operators.passages import contained as by_automata
from marlstone.operators.passages import near_pairs as by_shingles

#: Order of the detectors, which numbers the changes.
PHASES = ("typo", "fluency", "duplicate", "compliance")

# Pairs of a misspelling and its correction, frequent ones of two languages.
TYPOS = {
    "根剧": "根据", "综和": "综合", "按装": "安装", "布署": "部署", "震憾": "震撼", "松驰": "松弛", "渡假": "度假", "重迭": "重叠", "凑和": "凑合", "帐号": "账号",
    "accomodat": "accommodat", "acheive": "achieve", "adress": "address", "agressive": "aggressive", "apparant": "apparent", "arguement": "argument", "begining": "beginning", "beleive": "believe",
    "calender": "calendar", "commitee": "committee", "concious": "conscious", "definately": "definitely", "dissapoint": "disappoint", "embarass": "embarrass", "enviroment": "environment", "existance": "existence",
    "foriegn": "foreign", "goverment": "government", "grammer": "grammar", "harrass": "harass", "immediatly": "immediately", "independant": "independent", "judgement of": "judgment of", "knowlege": "knowledge",
    "liason": "liaison", "maintainance": "maintenance", "millenium": "millennium", "mispell": "misspell", "neccessary": "necessary", "noticable": "noticeable", "occured": "occurred", "occurence": "occurrence",
    "persistant": "persistent", "posession": "possession", "prefered": "preferred", "priviledge": "privilege", "publically": "publicly", "recieve": "receive", "recomend": "recommend", "refered": "referred",
    "relevent": "relevant", "rythm": "rhythm", "seperate": "separate", "succesful": "successful", "supercede": "supersede", "suprise": "surprise", "tommorow": "tomorrow", "truely": "truly",
    "untill": "until", "wierd": "weird", "withold": "withhold",
}

# A rule's id, the term it is on, the unit, the relation the number must have, and the limit.
LIMITS = (
    ("check_interval", "检查间隔", "小时", "<=", 2.0),
    ("gas_concentration", "浓度", "%", "<=", 1.0),
    ("air_temperature", "空气温度", "℃", "<=", 26.0),
    ("oxygen", "氧气", "%", ">=", 20.0),
)


def split_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int | None = None) -> DataFrame:
    """One row per paragraph: key, paragraph_index (from 0), content. window looks at so many first characters only."""
    body = F.substring(F.col(text), 1, window) if window else F.col(text)
    return docs.select(key, F.posexplode(paragraphs(body)).alias("paragraph_index", "content"))


def typos(paras: DataFrame, pairs: dict[str, str] | None = None) -> DataFrame:
    """Each known misspelling a paragraph holds."""
    known = F.array(*(F.struct(F.lit(a).alias("original"), F.lit(b).alias("corrected")) for a, b in (pairs or TYPOS).items()))
    hit = F.filter(known, lambda p: F.contains(F.col("content"), p["original"]))
    return paras.withColumn("p", F.explode(hit)).select(*paras.columns, "p.*").withColumn("reason", F.lit("misspelling")).drop("content")


def long_sentences(paras: DataFrame, most: int = 80) -> DataFrame:
    """Sentences of over so many characters."""
    sentence = F.explode(F.filter(F.regexp_extract_all("content", F.lit(r"[^。！？.!?]+[。！？.!?]?"), 0), lambda s: F.length(s) > most))
    return paras.select(*[c for c in paras.columns if c != "content"], sentence.alias("original"), F.lit("long sentence").alias("issue"))


def repeated_sentences(paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences found more than once in one paragraph, with the number of times."""
    sentences = F.filter(F.transform(F.split("content", "[。！？.!?]", -1), lambda s: F.trim(s)), lambda s: F.length(s) > 1)
    # only paragraphs that repeat one are taken apart
    twice = paras.where(F.size(F.array_distinct(sentences)) < F.size(sentences))
    found = twice.select(key, "paragraph_index", F.explode(sentences).alias("sentence"))
    return found.groupBy(key, "paragraph_index", "sentence").agg(F.count("*").alias("times")).where("times > 1")


def exact_classes(rows: DataFrame, key: str, text: str, by: list[str] | None = None) -> DataFrame:
    """Every row with the least key of the rows of its text and their number: class_id, class_size.

    Equal texts are folded by digest on the map side first; only digests are joined.
    """
    by = by or []
    # a struct, which is equal to another one with the same nulls
    marked = rows.select(*by, key, F.struct(*by, F.sha2(F.col(text), 256).alias("__digest")).alias("__class"))
    groups = marked.groupBy("__class").agg(F.min(key).alias("class_id"), F.count("*").alias("class_size"))
    return marked.join(groups, "__class").drop("__class")


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of size words; all words as one run where there are fewer."""
    ws = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")

    def runs(w: Column) -> Column:  # w is bound once: inside the inner function ws would be split anew for every run
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - size + 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return F.transform(F.array(ws), runs)[0]


def near_pairs(paras: DataFrame, key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of unlike paragraphs of one document whose shingle sets are similar: paragraph_index_1 < paragraph_index_2, similarity.

    A paragraph stands for its equals (the least index); exact_classes has those.
    A document's paragraphs travel once, to one row, and are compared there.
    """
    met = by_shingles(paras, key, size, percent)
    return met.select(key, F.col("i").alias("paragraph_index_1"), F.col("j").alias("paragraph_index_2"), F.round(F.col("both") / F.col("all"), 6).alias("similarity"))


def _limit_pattern(term: str, unit: str) -> str:
    return f"{term}[^0-9。]{{0,12}}([0-9]+(?:\\.[0-9]+)?)\\s*{unit}"


def compliance(paras: DataFrame, limits=LIMITS) -> DataFrame:
    """Numbers that break a rule: the rule's term, then within 12 characters a number with its unit."""
    out = []
    for rule, term, unit, relation, limit in limits:
        value = F.explode(F.regexp_extract_all("content", F.lit(_limit_pattern(term, unit)), 1))
        found = paras.where(F.contains("content", F.lit(term))).withColumn("value", value).withColumn("value", F.col("value").cast("double"))
        broken = F.col("value") > limit if relation == "<=" else F.col("value") < limit
        out.append(found.where(broken).select(*[c for c in paras.columns if c != "content"], "value", F.lit(rule).alias("reference"), F.lit(f"{relation} {limit:g} {unit}").alias("suggestion")))
    while len(out) > 1:
        out.append(out.pop(0).unionByName(out.pop(0)))
    return out[0]


def merge(findings: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """All findings with type, category and an id that counts per document in the detectors' order.

    A finding's own non-null id, type or category stands, as a model's reply may bring one.
    """
    parts = []
    for phase, name in enumerate(PHASES):
        if name not in findings:
            continue
        df = findings[name]
        own = lambda c, v, df=df: F.coalesce(F.col(c), v) if c in df.columns else v
        parts.append(df.withColumns({"type": own("type", F.lit(name)), "category": own("category", F.lit(name)), "__own": own("id", F.lit(None).cast("int")), "__phase": F.lit(phase)}).drop("id"))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    rest = [c for c in sorted(merged.columns) if c not in (key, "__phase", "__own") and merged.schema[c].dataType.typeName() not in ("array", "map", "struct")]
    place = F.row_number().over(Window.partitionBy(key).orderBy("__phase", *([F.asc_nulls_first("paragraph_index")] if "paragraph_index" in merged.columns else []), *rest))
    return merged.withColumn("id", F.coalesce("__own", place)).drop("__phase", "__own")


def scan(paras: DataFrame, pairs: dict[str, str] | None = None, limits=LIMITS) -> DataFrame:
    """Misspellings, repeated sentences and broken limits in one pass over the paragraphs: columns of paras but content, phase, type, original, corrected.

    The same findings as typos(), repeated_sentences() and compliance() give, each
    paragraph's as one array. A repeated sentence is one finding, a limit's
    original is the number.
    """
    of = lambda name, original, corrected: F.struct(F.lit(PHASES.index(name)).alias("phase"), F.lit(name).alias("type"), original.alias("original"), corrected.cast("string").alias("corrected"))
    known = F.array(*(F.struct(F.lit(a).alias("original"), F.lit(b).alias("corrected")) for a, b in (pairs or TYPOS).items()))
    found = [F.transform(F.filter(known, lambda p: F.contains(F.col("content"), p["original"])), lambda p: of("typo", p["original"], p["corrected"]))]
    sentences = F.sort_array(F.filter(F.transform(F.split("content", "[。！？.!?]", -1), lambda s: F.trim(s)), lambda s: F.length(s) > 1))
    second = lambda g: F.filter(g, lambda s, k: (s == F.get(g, k - 1)) & ~F.coalesce(s == F.get(g, k - 2), F.lit(False)))
    found.append(F.transform(F.transform(F.array(sentences), second)[0], lambda s: of("duplicate", s, F.lit(None))))
    for _, term, unit, relation, limit in limits:
        values = F.transform(F.regexp_extract_all("content", F.lit(_limit_pattern(term, unit)), 1), lambda v: v.cast("double"))
        broken = F.filter(values, lambda v: v > limit) if relation == "<=" else F.filter(values, lambda v: v < limit)
        found.append(F.transform(broken, lambda v: of("compliance", v.cast("string"), F.lit(None))))
    return paras.select(*[c for c in paras.columns if c != "content"], F.explode(F.concat(*found)).alias("__f")).select(*[c for c in paras.columns if c != "content"], "__f.*")


def numbered_findings(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What scan() finds, with category and an id that counts per document in the detectors' order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("phase", F.asc_nulls_first("paragraph_index"), F.asc_nulls_first("corrected"), "original"))
    return found.withColumn("id", place).withColumn("category", F.col("type")).drop("phase")


def counts(changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Changes by detector and in all."""
    return changes.groupBy(key).agg(F.count("*").alias("total_changes"), *(F.count_if(F.col("type") == p).alias(f"{p}_count") for p in PHASES))


def levels(issues: DataFrame, level: str = "level") -> DataFrame:
    """Issues by severity, of the three there are."""
    return issues.agg(*(F.count_if(F.col(level) == v).alias(n) for n, v in (("serious", "严重"), ("warnings", "警告"), ("advice", "建议"))))


def preferred(change: str | None = None) -> Column:
    """What a change puts in place: corrected, improved or suggestion, the first that says something."""
    at = (lambda c: F.col(f"{change}.{c}")) if change else F.col
    return first_of(at("corrected"), at("improved"), at("suggestion"))


def apply_changes(docs: DataFrame, changes: DataFrame, accepted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their accepted changes made: revised, applied, failed, total_accepted.

    changes: key, id, type, original, replacement; accepted: key, id. Typos come
    first, then fluency, then compliance; duplicates are never applied. Each
    change sees the text that the ones before left and replaces the first
    occurrence in the first paragraph that has one. A change without original or
    replacement counts neither way. total_accepted counts the ids asked for.
    """
    asked = accepted.groupBy(key).agg(F.count("*").alias("total_accepted"))
    order = F.when(F.col("type") == "typo", 0).when(F.col("type") == "fluency", 1).when(F.col("type") == "compliance", 2)
    usable = changes.join(accepted.select(key, "id").distinct(), [key, "id"], "left_semi").withColumn("phase", order)
    usable = usable.where("phase IS NOT NULL AND length(original) > 0 AND length(replacement) > 0")
    edits = usable.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("phase", "id", "original", "replacement"))).alias("__edits"))
    zero = F.struct(F.coalesce(F.col(text), F.lit("")).alias("t"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("f"))

    def step(s: Column, e: Column) -> Column:
        new = replace_first(s["t"], e["original"], e["replacement"])
        hit = F.contains(s["t"], e["original"])
        return F.struct(F.when(hit, new).otherwise(s["t"]).alias("t"), (s["a"] + hit.cast("bigint")).alias("a"), (s["f"] + (~hit).cast("bigint")).alias("f"))

    met = docs.join(edits, key, "left").join(asked, key, "left")
    done = met.withColumn("__r", F.aggregate(F.coalesce("__edits", F.array().cast(met.schema["__edits"].dataType)), zero, step))
    return done.select(*docs.columns, F.col("__r.t").alias("revised"), F.col("__r.a").alias("applied"), F.col("__r.f").alias("failed"), F.coalesce("total_accepted", F.lit(0)).alias("total_accepted"))


def marked_spans(docs: DataFrame, changes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Where the first occurrence of each change's original begins and ends (from 0, end exclusive), for a comparison view."""
    met = changes.join(docs.select(key, F.col(text).alias("__t")), key)
    at = F.position(F.col("original"), F.col("__t"))
    return met.where((F.length("original") > 0) & (at > 0)).select(*changes.columns, (at - 1).cast("bigint").alias("start"), (at - 1 + F.length("original")).cast("bigint").alias("end"))


def review(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The four detectors side by side and their findings merged."""
    paras = split_paragraphs(docs, key, text)
    repeats = repeated_sentences(paras, key).select(key, "paragraph_index", F.col("sentence").alias("original"), F.lit("remove the repetition").alias("suggestion"))
    return merge({"typo": typos(paras), "fluency": long_sentences(paras), "duplicate": repeats, "compliance": compliance(paras)}, key)


def result_view(tasks: DataFrame, ddl: str) -> DataFrame:
    """A task's state: its result only once completed, its error only where it failed."""
    shown = F.when((F.col("status") == "completed") & (F.length("result") > 0), F.from_json("result", ddl))
    return tasks.select("task_id", "status", "progress", shown.alias("result"), F.when((F.col("status") == "failed") & (F.length("error_msg") > 0), F.col("error_msg")).alias("error"))


def step_of(progress: Column) -> Column:
    """The step of a review at a progress in percent."""
    return F.when(progress >= 100, 4).when(progress >= 75, 3).when(progress >= 50, 2).when(progress >= 25, 1).otherwise(0)


def result(docs: DataFrame, changes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A review's result: the original, the revised content (the original still, for no change is made before it is accepted) and the counts."""
    counted = counts(changes, key)
    met = docs.select(key, F.col(text).alias("original_content"), F.col(text).alias("revised_content")).join(counted, key, "left")
    return met.fillna(0, [c for c in counted.columns if c != key])


def analysis_state(status: Column) -> Column:
    """What a request to analyse a task gets: one that is at work stays as it is, a missing one is not found."""
    return F.when(status.isNull(), "404").when(status == "processing", "already processing").otherwise("started")


def apply_state(status: Column, result: Column) -> Column:
    """What a request to apply a task's changes gets: only a completed one with a result can be applied."""
    return F.when(status.isNull(), "404").when(status != "completed", "400 not completed").when(F.coalesce(F.length(result), F.lit(0)) == 0, "400 no result").otherwise("200")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "no") -> DataFrame:
    """Rows with a serial number (from 1) within each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def contained(docs: DataFrame, passages: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", size: int = 5) -> DataFrame:
    """Pairs of a document and a passage that it contains, letter for letter. Passages without a word are in no pair.

    By automata of all passages, which every text runs through once; where the
    passages are too many for that, by an equi-join on runs of at most size words.
    """
    worded = passages.where(F.col(text).rlike(r"\S"))
    parts = parts_of(worded, text)
    if parts <= PASSES:
        return by_automata(docs, worded, key, item, text, parts).distinct()
    return contained_by_join(docs, passages, key, item, text, size).distinct()  # rows of one key may hold the same


def contained_by_join(docs: DataFrame, passages: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", size: int = 5) -> DataFrame:
    """contained() for any number of passages.

    A passage's inner words (its first and last may be parts of words) stand in
    the document as they are, so runs of at most size of them find candidates by
    an equi-join on a hash; each is then confirmed. A passage of one or two
    words is found by its first three letters in the same way. Documents are
    taken apart only in the ways that the passages call for.
    """
    ws = F.filter(F.split(F.col(text), r"\s+", -1), lambda w: w != "")
    split = passages.where(F.col(text).rlike(r"\S")).select(item, F.col(text).alias("__passage"), ws.alias("__w"))
    by_words = F.size("__w") > 2
    n = F.when(by_words, F.least(F.lit(size), F.size("__w") - 2)).otherwise(F.least(F.lit(3), F.length("__passage")))
    anchor = F.when(by_words, F.array_join(F.slice("__w", F.lit(2), n), " ")).otherwise(F.substr("__passage", F.lit(1), n))
    items = split.select(item, "__passage", by_words.alias("__words"), n.alias("__n"), F.xxhash64(anchor).alias("__h"))
    starts = lambda whole, k: F.when(whole >= k, F.sequence(F.lit(1), whole - (k - 1))).otherwise(F.array().cast("array<int>"))
    found = None
    for r in items.select("__words", "__n").distinct().collect():  # at most size + 3 kinds
        k = r["__n"]
        if r["__words"]:
            taken = docs.select(key, ws.alias("__w")).select(key, F.transform(starts(F.size("__w"), k), lambda i: F.xxhash64(F.array_join(F.slice("__w", i, k), " "))).alias("__runs"))
        else:
            taken = docs.select(key, F.transform(starts(F.length(text), k), lambda i: F.xxhash64(F.substr(F.col(text), i, F.lit(k)))).alias("__runs"))
        each = taken.select(key, F.explode(F.array_distinct("__runs")).alias("__h"))
        own = items.where((F.col("__n") == k) & (F.col("__words") == r["__words"])).select(item, "__h")
        part = each.join(own, "__h").select(key, item)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select(key).join(passages.select(item), F.lit(False))
    met = found.distinct().join(docs.select(key, F.col(text).alias("__text")), key).join(items.select(item, "__passage"), item)
    return met.where(F.contains("__text", F.col("__passage"))).select(key, item)


def stated(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Statements of a number in texts: key, term, value; pattern's first group is the term, its second the number."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("term"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("value"))
    each = rows.select(key, F.explode(pairs).alias("p"))
    return each.select(key, F.col("p.term").alias("term"), F.col("p.value").cast("double").alias("value")).distinct()


def compared(documents: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The table of what documents state otherwise than the rules: key, no, requirement, passage, mismatch, suggestion.

    Both: key (documents only), term, value. Numbers of one term meet; of a term
    with several required numbers, each that differs gives a row.
    """
    met = documents.join(rules.select("term", F.col("value").alias("required")), "term").where(F.col("value") != F.col("required"))
    said = lambda c: F.concat("term", F.lit(" "), fixed(F.col(c), 2))
    out = met.select(key, said("required").alias("requirement"), said("value").alias("passage"), fixed(F.col("value") - F.col("required"), 2).alias("mismatch"), F.concat(F.lit("state "), said("required")).alias("suggestion"))
    return numbered(out, [key], ["requirement", "passage"]).select(key, "no", "requirement", "passage", "mismatch", "suggestion")


def glossary(paras: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Loose words with the term of a glossary that should stand for them, as fluency findings."""
    found = typos(paras, terms).withColumnRenamed("corrected", "improved")
    return found.withColumn("reason", F.lit("glossary"))


def relations(paras: DataFrame, pattern: str, relation: str, limit: float) -> DataFrame:
    """Numbers (the pattern's first group) that do not stand in the relation (<, <=, >, >=) to the limit: columns of paras but content, and value."""
    value = F.explode(F.regexp_extract_all("content", F.lit(pattern), 1))
    found = paras.select(*[c for c in paras.columns if c != "content"], value.alias("value")).withColumn("value", F.col("value").cast("double"))
    holds = {"<": F.col("value") < limit, "<=": F.col("value") <= limit, ">": F.col("value") > limit, ">=": F.col("value") >= limit}[relation]
    return found.where(~holds)


#: Severity of a detector's findings in a final report.
LEVELS = {"compliance": "severe", "typo": "warning", "fluency": "suggestion", "duplicate": "suggestion"}


def final_report(docs: DataFrame, changes: DataFrame, pairs: dict[str, str], key: str = "doc_id", text: str = "text", most: int = 500) -> DataFrame:
    """A document's report at the end of the five steps: found, judged, related, rewritten, summed up.

    key, is_compliant (nothing severe), issues in all and by severity,
    dependencies (further paragraphs with the same wording as one that changes),
    revised_content (known misspellings replaced, each once) and summary, its
    first characters. Documents without findings are compliant.
    """
    level = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))[F.col("type")]
    counted = changes.groupBy(key).agg(F.count("*").alias("total_issues"), *(F.count_if(level == v).alias(f"{v}_issues") for v in ("severe", "warning", "suggestion")))
    places = changes.select(key, "original", "paragraph_index").distinct().groupBy(key, "original").agg((F.count("*") - 1).alias("__more"))
    related = places.groupBy(key).agg(F.sum("__more").alias("dependencies"))
    known = F.array(*(F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in pairs.items())) if pairs else F.array().cast("array<struct<old:string,new:string>>")
    revised = F.aggregate(known, F.col(text), lambda t, p: replace_first(t, p["old"], p["new"]))
    met = docs.select(key, revised.alias("revised_content")).join(counted, key, "left").join(related, key, "left").fillna(0, [*counted.columns[1:], "dependencies"])
    return met.withColumn("is_compliant", F.col("severe_issues") == 0).withColumn("summary", F.substring("revised_content", 1, most))
