"""Text features as column expressions over transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.match import find_terms, tokens


#: Where a word begins and ends, whatever letters it has.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def strip_speaker_labels(text: Column) -> Column:
    """Without ``Name Name:`` at the beginning of lines."""
    return F.regexp_replace(text, r"(?m)^[A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*){0,3}:[ \t]*", "")


def sanitize_text(text: Column, strict: bool = False) -> Column:
    """Control characters as spaces; strict takes runs of white space as one space and trims."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.trim(F.regexp_replace(clean, r"[ \t\n\r]+", " ")) if strict else clean


def control_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))


def overlap_tokens(text: Column) -> Column:
    """Ordered distinct words of 4 characters, or of 3 that are no number."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) | ((F.length(w) == 3) & ~w.rlike("^[0-9]+$"))))


def token_overlap(a: Column, b: Column) -> Column:
    return F.array_intersect(overlap_tokens(a), overlap_tokens(b))


def normalize_alias_terms(aliases: DataFrame, shortest: int = 4, most: int = 25) -> DataFrame:
    """Trimmed aliases, case-insensitively distinct per project, by first position, at most ``most``."""
    rows = aliases.select("project_id", F.trim("alias").alias("alias"), "position").where(F.length("alias") >= shortest)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("project_id", F.lower("alias")).orderBy("position", "alias"))).where("_n = 1")
    return first.withColumn("_m", F.row_number().over(Window.partitionBy("project_id").orderBy("position", "alias"))).where(F.col("_m") <= most).select("project_id", "alias")


def snippet_around(text: Column, start: Column, length: Column, margin: int = 40, most: int = 100) -> Column:
    """The text around a match (start from 1), white space as one space, with dots where it is cut."""
    lo = F.greatest(F.lit(1), start - margin)
    hi = F.least(F.length(text), start + length - 1 + margin)
    core = F.substring(F.trim(F.regexp_replace(F.substring(text, lo, hi - lo + 1), r"\s+", " ")), 1, most)
    return F.concat(F.when(lo > 1, "...").otherwise(""), core, F.when(hi < F.length(text), "...").otherwise(""))


def truncate_around(text: Column, first: Column, last: Column, most: int) -> Column:
    """``most`` characters centred on the first to the last match."""
    lo = F.greatest(F.lit(1), F.least(F.floor((first + last) / 2 - most / 2), F.length(text) - most + 1)).cast("int")
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, lo, F.lit(most)))


def normalize_phone(phone: Column) -> Column:
    """Digits only, the last ten of longer numbers."""
    d = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(d) > 10, F.right(d, F.lit(10))).when(d != "", d)


def extract_amounts(text: Column) -> Column:
    """Amounts in dollars in order: $ figures with k or m, and figures before dollars, apiece or each."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\$ ?[0-9][0-9,]*(?:\.[0-9]+)? ?(?:k\b|m\b|thousand\b|million\b)?|[0-9][0-9,]*(?:\.[0-9]+)? (?:dollars|apiece|each)\b)"), F.lit(1))
    number = lambda x: F.regexp_replace(x, "[^0-9.]", "").cast("double") * F.when(x.rlike(r"[0-9 ](m|million)$"), 1e6).when(x.rlike(r"[0-9 ](k|thousand)$"), 1e3).otherwise(1.0)
    return F.transform(found, number)


def extract_proper_nouns(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Capitalized words that do not begin a sentence and are no stopword, distinct."""
    words = F.regexp_extract_all(text, F.lit(rf"(?<=[a-z0-9,;] )([A-Z][a-z]{{2,}}){AFTER}"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~F.lower(w).isin(*stop)) if stop else words)


def normalize_quote(text: Column) -> Column:
    """Lower case, quotes gone, dashes as spaces, letters, digits and single spaces only; ligatures and wide forms folded."""
    folded = F.translate(F.lower(text), "‘’“”–— ", "''\"\"-- ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, "['\"]", ""), "-", " "), "[^a-z0-9]+", " "))


def verify_quotes(anchors: DataFrame) -> DataFrame:
    """Whether each quote (anchor_id, quote, text) is in its text: as it is, or, with 3 words or more, within a few edits of a window."""
    q, t = normalize_quote(F.col("quote")), normalize_quote(F.col("text"))
    rows = anchors.withColumn("_q", q).withColumn("_t", t).withColumn("_w", F.split("_t", " ")).withColumn("_n", F.size(F.split("_q", " ")))
    most = F.greatest(F.lit(3), F.ceil(F.length("_q") * 0.18)).cast("int")
    sizes = F.sequence(F.greatest(F.lit(1), F.floor(F.col("_n") * 0.75).cast("int")), F.ceil(F.col("_n") * 1.25).cast("int"))
    near = lambda k: F.exists(F.sequence(F.lit(0), F.size("_w") - k), lambda i: F.levenshtein(F.array_join(F.slice("_w", i + 1, k), " "), F.col("_q")) <= most)
    fuzzy = F.exists(sizes, lambda k: F.when(F.size("_w") >= k, near(k)).otherwise(False))
    how = F.when(F.col("_q") == "", "empty").when(F.contains("_t", F.col("_q")), "exact").when((F.col("_n") >= 3) & fuzzy, "fuzzy").otherwise("missing")
    return rows.select("anchor_id", how.alias("verified"))


def extract_speakers(transcripts: DataFrame) -> DataFrame:
    """Speaker labels at line starts and how many lines each has."""
    lines = transcripts.select("interaction_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("speaker", F.regexp_extract("line", r"^\s*([A-Za-z][A-Za-z .'-]{0,40}):", 1))
    return lines.where("speaker <> ''").groupBy("interaction_id", "speaker").agg(F.count("*").alias("n_lines"))


def normalize_duration(seconds: Column) -> Column:
    """Over 10,000 is taken as milliseconds; what is not positive as unknown."""
    return F.when(seconds <= 0, None).when(seconds > 10000, seconds / 1000.0).otherwise(seconds)


#: Phrases of calls that reached a voicemail or failed, by code, and words that show substance.
VOICEMAIL = {
    "voicemail_leave_message": r"\bleave (?:me )?(?:a )?message\b", "voicemail_mailbox_full": r"\bmailbox is (?:full|not set up)\b", "voicemail_not_available": r"\b(?:cannot|can't|unable to)\s+take your call\b",
    "voicemail_after_tone": r"\bafter the tone\b", "voicemail_record_message": r"\bplease record your message\b",
}
CONNECTION = {"connection_bad_service": r"\bbad service\b", "connection_call_dropped": r"\bcall (?:dropped|failed|disconnected)\b", "connection_cant_hear": r"\b(?:can you|can't|cannot)\s+hear (?:me|you)\b"}
SUBSTANCE = (r"\bestimate\b", r"\bproposal\b", r"\bcontract\b", r"\binvoice\b", r"\bdeposit\b", r"\bpermit\b", r"\bschedule\b", r"\bchange order\b", r"\binstall(?:ation)?\b", r"\bcabinets?\b", r"\bcountertops?\b", r"\btile\b", r"\bplumbing\b", r"\belectrical\b", r"\$\s*\d+")
TURN = r"(?:^|\n)\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s*:"


def junk_prefilter(calls: DataFrame, voicemail: dict[str, str] = VOICEMAIL, connection: dict[str, str] = CONNECTION, substance: tuple[str, ...] = SUBSTANCE, least_words: int = 20, short_seconds: int = 15, voicemail_words: int = 80, failure_words: int = 40) -> DataFrame:
    """Whether a call has no content, why, and the signals; ``calls`` has interaction_id, text, duration_seconds.

    Junk are voicemails of up to ``voicemail_words`` words, failed connections
    of up to ``failure_words`` and calls of under ``least_words`` with one turn
    at most or under ``short_seconds``; the last two only without a word of
    substance. Empty texts are no junk. Reason codes stand in the order of the rules.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    hits = lambda family: F.array_compact(F.array(*(F.when(F.regexp_like("_t", F.lit(f"(?i){p}")), code) for code, p in family.items())))
    seconds = F.floor(normalize_duration(F.col("duration_seconds")) + 0.5)
    rows = calls.withColumn("_t", text).select("interaction_id", F.regexp_count("_t", F.lit("(?i)[a-z0-9']+")).alias("words"), F.regexp_count("_t", F.lit(TURN)).alias("turns"), seconds.alias("seconds"), hits(voicemail).alias("_v"), hits(connection).alias("_c"), F.regexp_like("_t", F.lit(f"(?i){'|'.join(substance)}")).alias("substantive"))
    n, few, single, short = F.col("words"), (F.col("words") > 0) & (F.col("words") < least_words), F.col("turns") <= 1, F.coalesce(F.col("seconds") < short_seconds, F.lit(False))
    v, c = (F.size("_v") > 0) & (n <= voicemail_words), (F.size("_c") > 0) & (n <= failure_words) & ~F.col("substantive")
    junk = v | c | (few & (single | short) & ~F.col("substantive"))
    codes = F.array_compact(F.array(F.lit("junk_call_filtered"), F.when(v, "voicemail_pattern"), F.when(c, "connection_failure_pattern"), F.when(few, "low_word_count"), F.when(single, "single_speaker_turn"), F.when(short, "short_duration")))
    return rows.select("interaction_id", "words", "turns", "seconds", "substantive", F.concat_ws("|", F.concat("_v", "_c")).alias("hits"), junk.alias("junk"), F.when(junk, F.concat_ws(",", codes)).otherwise("").alias("codes"))


def classify_prospect(calls: DataFrame, evidence: tuple[str, ...], commitment: tuple[str, ...]) -> DataFrame:
    """Confidence that a call is from a prospect, by how many patterns hit, and whether it commits."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = lambda ps: sum((low.rlike(p).cast("int") for p in ps), F.lit(0))
    e = hits(evidence)
    return calls.select("interaction_id", e.alias("evidence_hits"), F.when(e >= 2, "high").when(e == 1, "medium").otherwise("none").alias("prospect"), (hits(commitment) > 0).alias("committed"))


def find_callbacks(calls: DataFrame, phrases: tuple[str, ...] = ("call you back", "calling you back", "returning your call", "as we discussed", "following up", "like i said"), most: int = 5) -> DataFrame:
    """Callback phrases in order of the list, with a snippet of up to 80 characters."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = F.slice(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)), 1, most)
    return calls.select("interaction_id", F.explode(found).alias("phrase"), low.alias("_t")).select("interaction_id", "phrase", F.substring(F.col("_t"), F.greatest(F.lit(1), F.instr("_t", F.col("phrase")) - 20), F.lit(80)).alias("snippet"))


def contact_notes_pii(contacts: DataFrame) -> DataFrame:
    """Contacts whose notes hold an e-mail address or a phone number."""
    mail, phone = F.col("notes").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.col("notes").rlike(r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b")
    return contacts.where(mail | phone).select("id", mail.alias("has_email"), phone.alias("has_phone"))


def callout_material_signal(spans: DataFrame, materials: DataFrame, base: float = 0.08, cap: float = 0.45) -> DataFrame:
    """Per span the clamped sum of ``base`` and boost of the active materials it names."""
    hit = find_terms(spans, materials.where("active").select("term", "boost"), "span_id")
    return hit.groupBy("span_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(cap), F.sum(base + F.col("boost")))).alias("score"), F.count("*").alias("n_materials"))


def detect_place_role(text: Column, place_start: Column, destination: str, origin: str, back: int = 60) -> Column:
    """destination, origin or proximity by the verbs in the ``back`` characters before a place."""
    before = F.lower(F.substring(text, F.greatest(F.lit(1), place_start - back), F.least(F.lit(back), place_start - 1)))
    return F.when(before.rlike(destination), "destination").when(before.rlike(origin), "origin").otherwise("proximity")


def high_signal_terms(texts: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Scored terms of a text: addresses, amounts, quantities, names, model numbers, words, each as whole words of any letters; the best ``most``."""
    low = F.lower("text")
    whole = lambda pattern: F.regexp_extract_all(low, F.lit(rf"{BEFORE}({pattern}){AFTER}"), F.lit(1))
    classes = [
        (100, whole(r"[0-9]{2,5} [a-z]+ (?:street|st|road|rd|lane|ln|drive|dr|avenue|ave)")),
        (95, F.regexp_extract_all(low, F.lit(r"(\$ ?[0-9][0-9,]*)"), F.lit(1))),
        (90, whole(r"[0-9]+ (?:feet|foot|inch|inches|yards|gallons|pieces|boxes|sheets)")),
        (88, F.transform(extract_proper_nouns(F.col("text")), lambda x: F.lower(x))),
        (82, whole(r"[a-z]{1,4}-?[0-9]{3,6}")),
        (72, F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 7)),
    ]
    rows = None
    for score, terms in classes:
        part = texts.where("text IS NOT NULL").select(key, F.explode(F.array_distinct(terms)).alias("term"), F.lit(score).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy(key, "term").agg(F.max("score").alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc(F.length("term")), "term")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
