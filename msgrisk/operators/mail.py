"""Raw messages as entity tables, and the checks over headers and attachments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.functions import hosts as hx
from msgrisk.functions import text as tx
from msgrisk.functions import unicode as uni
from msgrisk.functions.mime import message_entities
from msgrisk.session import bounded_batches, materialize

KEY = ["root_id", "msg_path"]
#: Messages that one task decodes, and their bytes.
PIECE_MESSAGES, PIECE_BYTES = 2_000, 8_000_000


def message_pieces(raw: DataFrame, content: str) -> DataFrame:
    """``raw`` dealt out evenly over as many tasks as its messages and bytes ask for; the splits of its files hold far more."""
    size = raw.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(content).cast("bigint")).alias("bytes")).first()
    pieces = max(size["n"] // PIECE_MESSAGES, (size["bytes"] or 0) // PIECE_BYTES) + 1
    return raw if pieces == 1 else raw.repartition(max(pieces, raw.sparkSession.sparkContext.defaultParallelism))


def ingest_eml(raw: DataFrame, root: str = "path", content: str = "content") -> dict[str, DataFrame]:
    """``messages``, ``headers``, ``parts`` and ``attachments`` of raw messages.

    Every message is decoded once; the decoded entities are written to the checkpoint folder
    and the four tables are projections of that copy.
    """
    decoded = bounded_batches(message_pieces(raw, content)).select(F.col(root).alias("root_id"), F.explode(message_entities(content)).alias("e"))
    e = materialize(decoded.select("root_id", "e.*"))
    header = lambda name: F.filter("headers", lambda h: h["name"] == name)
    messages = e.select(
        *KEY, F.size("msg_path").alias("depth"),
        F.array_join(F.transform(header("subject"), lambda h: h["value"]), "\n").alias("subject"), "warnings",
    )
    return {
        "messages": messages,
        "headers": e.select(*KEY, F.explode("headers").alias("h")).select(*KEY, "h.*"),
        "parts": e.select(*KEY, F.explode("parts").alias("p")).select(*KEY, "p.*"),
        "attachments": e.select(*KEY, F.explode("attachments").alias("a")).select(*KEY, "a.*").distinct(),
    }


def with_unicode(rows: DataFrame, needed: Column, change) -> DataFrame:
    """Apply ``change`` to the few rows that need Unicode work; the others never leave the JVM."""
    needed = F.coalesce(needed, F.lit(False))
    return rows.where(~needed).unionByName(change(rows.where(needed)))


def mailboxes(headers: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One row per mailbox of an address header, with its domain in ASCII form (empty if it has none)."""
    boxes = headers.select(*key, "name", "ord", F.posexplode("mailboxes").alias("box_ord", "m")).select(
        *key, "name", "ord", "box_ord", "m.display", F.lower(F.trim("m.address")).alias("address"),
        F.regexp_replace(F.lower(F.regexp_extract("m.address", r"@([^@]*)$", 1)), r"\.+$", "").alias("domain"),
    )
    foreign = F.col("domain").rlike(r"[^\x00-\x7f]")
    return with_unicode(boxes, foreign, lambda rows: rows.withColumn("domain", uni.encode_idna("domain")))


def brand_display_identity(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Points for a protected brand shown from, or imitated by, an unrelated domain."""
    senders = boxes.where("name = 'from'").withColumns({
        "_shown": tx.latin_skeleton("display"), "_skeleton": tx.latin_skeleton("domain"), "_plain": tx.casefold("domain"),
    })
    foreign = uni.needs_unicode(F.col("domain")) | F.col("display").rlike(r"[^\x00-\x7f]")
    senders = with_unicode(senders, foreign, lambda rows: rows.withColumn("_plain", uni.decode_idna("domain")).withColumns({
        "_shown": uni.confusable_skeleton(F.col("display")), "_skeleton": uni.confusable_skeleton(F.col("_plain")),
    }))
    shown = F.regexp_replace("_shown", r"\p{Cf}", "")
    skeleton = F.col("_skeleton")
    label = F.substring_index(skeleton, ".", 1)
    changed = skeleton != F.col("_plain")
    points = []
    for brand in hx.PROTECTED_BRANDS:
        stranger = ~hx.canonical_for("domain", brand)
        spelled = tx.BEFORE_WORD + rf"[^\p{{L}}\p{{N}}]*".join(brand) + tx.AFTER_WORD
        points += [F.when(stranger & shown.rlike(spelled), 4).otherwise(0), F.when(stranger & changed & label.contains(brand), 4).otherwise(0)]
    scored = senders.select(*key, reduce(lambda a, b: a + b, points).alias("points"))
    return scored.groupBy(*key).agg(F.max("points").alias("points")).where("points > 0")


def routing_mismatch(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Messages whose reply or bounce domain aligns with no From domain (one weak concern)."""
    domains = boxes.where("domain <> ''").groupBy(*key).agg(
        F.collect_set(F.when(F.col("name") == "from", F.col("domain"))).alias("senders"),
        F.collect_set(F.when(F.col("name").isin("reply-to", "return-path"), F.col("domain"))).alias("routes"),
    )
    strange = F.exists("routes", lambda r: ~F.exists("senders", lambda s: hx.domains_align(r, s)))
    return domains.where((F.size("senders") > 0) & strange).select(*key, F.lit(2).alias("points"))


def recipients(boxes: DataFrame, key: list[str], messages: DataFrame | None = None) -> DataFrame:
    """Whether a message has visible recipients and whether it is addressed to its own sender.

    With ``messages`` a message without any mailbox has its row as well.
    """
    sets = boxes.groupBy(*key).agg(
        F.collect_set(F.when(F.col("name") == "from", F.col("address"))).alias("senders"),
        F.collect_set(F.when(F.col("name").isin("to", "cc"), F.col("address"))).alias("to"),
    )
    found = sets.select(*key, (F.size("to") == 0).alias("no_visible_recipient"), F.arrays_overlap("senders", "to").alias("self_addressed"))
    if messages is None:
        return found
    every = messages.select(*key).distinct().join(found, key, "left")
    return every.select(*key, F.coalesce("no_visible_recipient", F.lit(True)).alias("no_visible_recipient"),
                        F.coalesce("self_addressed", F.lit(False)).alias("self_addressed"))


FAILED = ["fail", "softfail", "permerror", "temperror"]


def _auth_clauses(value: Column) -> Column:
    """One walk over the characters: clauses outside strings and (nested) comments, and whether all of those end."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit("").alias("text"),
    )

    def step(s: Column, c: Column) -> Column:
        comment, quoted = s["depth"] > 0, s["quoted"]
        skips = ~s["escaped"] & (c == "\\") & (comment | quoted)
        opens = ~s["escaped"] & ~quoted & (c == "(")
        closes = ~s["escaped"] & comment & (c == ")")
        quote = ~s["escaped"] & ~comment & (c == '"')
        shown = (
            F.when(comment, "").when(opens, " ")
            .when((c == ";") & (quoted | s["escaped"]), " ").when(c == ";", "\n").when(F.ascii(c) <= 32, " ").otherwise(c)
        )
        return F.struct(
            (s["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"), (quoted != quote).alias("quoted"),
            skips.alias("escaped"), F.concat(s["text"], shown).alias("text"),
        )

    def finish(s: Column) -> Column:
        clauses = F.transform(F.split(s["text"], "\n"), lambda c: F.trim(F.regexp_replace(c, " +", " ")))
        return F.struct(clauses.alias("clauses"), ((s["depth"] == 0) & ~s["quoted"] & ~s["escaped"]).alias("closed"))

    return F.aggregate(F.split(value, ""), start, step, finish)


def parse_auth_results(value: str = "value") -> Column:
    """Struct ``(authserv_id, results, complete)``; text in comments or quotes never counts.

    The first clause is the server's name and never a claim; of several claims for a mechanism the last counts.
    Incomplete claims cannot confer a pass.
    """
    pattern = r"^(spf|dkim|dmarc)(?: ?/ ?\d+)? ?= ?([a-z]+)(?: |$)"

    def read(walked: Column) -> Column:
        clauses = walked["clauses"]
        identity = F.regexp_extract(F.lower(F.get(clauses, 0)), r'^"?([^\s";]+)"?(?: \d+)?$', 1)
        later = F.slice(clauses, F.lit(2), F.greatest(F.size(clauses) - 1, F.lit(0)))
        claims = F.filter(F.transform(later, F.lower), lambda c: c.rlike(pattern))
        complete = (identity != "") & walked["closed"]
        pairs = F.transform(claims, lambda c: F.struct(F.regexp_extract(c, pattern, 1).alias("key"), F.regexp_extract(c, pattern, 2).alias("value")))

        def result(mechanism: str) -> Column:
            own = F.filter(pairs, lambda p: p["key"] == mechanism)
            value = F.when(F.size(own) > 0, F.element_at(own, -1)["value"])
            return F.when(complete | (value != "pass"), value).alias(mechanism)

        results = F.struct(*[result(m) for m in ("spf", "dkim", "dmarc")])
        return F.struct(identity.alias("authserv_id"), results.alias("results"), complete.alias("complete"))

    return tx.let(_auth_clauses(F.col(value)), read)


def auth_verdict(headers: DataFrame, key: list[str], trusted_ids: list[str]) -> DataFrame:
    """Verdict of the first header from a trusted server that carries a result."""
    parsed = headers.where("name = 'authentication-results'").select(*key, "ord", parse_auth_results().alias("a"))
    claims = F.coalesce("a.results.spf", "a.results.dkim", "a.results.dmarc").isNotNull()
    trusted = F.col("a.authserv_id").isin([t.strip().lower() for t in trusted_ids]) & claims
    per = parsed.groupBy(*key).agg(
        F.min_by(F.when(trusted, F.col("a.results")), F.when(trusted, F.col("ord"))).alias("r"),
        # Claims behind the first trusted header are shown, but not believed.
        (F.count_if(claims) - F.max(trusted.cast("int"))).alias("untrusted_claims"),
        F.count_if(~F.col("a.complete")).alias("incomplete"),
    )
    failed = lambda m: F.coalesce(F.col(f"r.{m}").isin(FAILED), F.lit(False))
    passes = F.coalesce(F.col("r.dmarc") == "pass", F.lit(False))
    decisive = failed("dmarc") | (failed("spf") & failed("dkim"))
    any_failure = failed("spf") | failed("dkim") | failed("dmarc")
    verdict = F.when(decisive & ~passes, "failed").when(any_failure & ~passes, "partial_failure").when(passes, "trusted").otherwise("none")
    points = F.when(decisive & ~passes, 6).when(any_failure & ~passes, 2).otherwise(0)
    return per.select(
        *key, verdict.alias("verdict"), points.alias("points"), F.when(verdict == "failed", "high").otherwise("safe").alias("floor"),
        "untrusted_claims", "incomplete",
    )


# Attachment types by extension and media type.
DANGEROUS_EXTENSIONS = [
    ".bat", ".chm", ".cmd", ".com", ".dll", ".docm", ".exe", ".hta", ".html", ".htm", ".img", ".iso", ".jar", ".js", ".lnk",
    ".msi", ".one", ".ps1", ".scr", ".vbs", ".vhd", ".vhdx", ".wsf", ".xlam", ".xlsm", ".xll",
]
ARCHIVE_EXTENSIONS = [".7z", ".gz", ".rar", ".tar", ".tgz", ".zip"]
DANGEROUS_MIME = [
    "application/java-archive", "application/javascript", "application/vnd.microsoft.portable-executable",
    "application/vnd.ms-excel.addin.macroenabled.12", "application/vnd.ms-excel.sheet.binary.macroenabled.12",
    "application/vnd.ms-excel.sheet.macroenabled.12", "application/vnd.ms-excel.template.macroenabled.12",
    "application/vnd.ms-powerpoint.addin.macroenabled.12", "application/vnd.ms-powerpoint.presentation.macroenabled.12",
    "application/vnd.ms-powerpoint.slideshow.macroenabled.12", "application/vnd.ms-powerpoint.template.macroenabled.12",
    "application/vnd.ms-word.document.macroenabled.12", "application/vnd.ms-word.template.macroenabled.12",
    "application/x-apple-diskimage", "application/x-bat", "application/x-dosexec", "application/x-executable",
    "application/x-iso9660-image", "application/x-java-archive", "application/x-msdos-program", "application/x-msdownload",
    "application/x-sh", "text/javascript",
]
ARCHIVE_MIME = [
    "application/gzip", "application/vnd.rar", "application/x-7z-compressed", "application/x-gzip",
    "application/x-rar-compressed", "application/x-tar", "application/x-zip-compressed", "application/zip",
]


def attachment_risk(attachments: DataFrame, key: list[str]) -> DataFrame:
    """Points and floor from distinct attachments; judged by name and media type alone."""
    name = F.lower(F.regexp_extract("filename", r"([^/]*)$", 1))
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    media = F.trim(F.substring_index(F.lower("content_type"), ";", 1))
    dangerous = suffix.isin(DANGEROUS_EXTENSIONS) | media.isin(DANGEROUS_MIME)
    archive = suffix.isin(ARCHIVE_EXTENSIONS) | media.isin(ARCHIVE_MIME)
    kind = F.when(dangerous, "dangerous").when(archive, "archive")
    return attachments.withColumn("kind", kind).where("kind IS NOT NULL").groupBy(*key).agg(
        F.sum(F.when(F.col("kind") == "dangerous", 4).otherwise(2)).cast("int").alias("points"),
        F.when(F.max(F.col("kind") == "dangerous"), "high").otherwise("medium").alias("floor"),
    )


def duplicate_headers(headers: DataFrame, key: list[str]) -> DataFrame:
    """Identity headers that occur more than once make the analysis incomplete."""
    named = headers.where(F.col("name").isin("from", "to", "cc", "subject", "reply-to", "return-path"))
    return named.groupBy(*key, "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def mime_views(parts: DataFrame, key: list[str], limit: int = 1024) -> DataFrame:
    """Renderings ``(key..., view, body, uncertain, truncated)`` of a message with alternative branches, default first.

    Every choice of one branch for each group is a view: the first branches, then each part's own path on top of them
    (shallow ones first), then all further choices in order. A part belongs to a view when all its steps agree with the
    choice, so choices inside a branch that was not taken give equal texts. Views of equal text are one, and only as
    uncertain as the most certain of them (``parts.uncertain``, if given). More than ``limit`` choices set ``truncated``;
    those kept still cover every branch path that fits. A message's parts are one array, as its bytes were.
    """
    unsure = F.col("uncertain") if "uncertain" in parts.columns else F.lit(False)
    part = F.struct("part_ord", "content", "alternative_path", unsure.alias("uncertain"))
    bundle = parts.groupBy(*key).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    steps = F.array_sort(F.array_distinct(F.flatten(F.transform("_parts", lambda p: p["alternative_path"]))))
    bundle = bundle.withColumn("_steps", steps).withColumn("_groups", F.array_distinct(F.transform("_steps", lambda s: s["grp"])))
    branches = F.transform("_groups", lambda g: F.transform(F.filter("_steps", lambda s: s["grp"] == g), lambda s: s["branch"]))
    paths = F.array_sort(F.array_distinct(F.transform("_parts", lambda p: F.struct(F.size(p["alternative_path"]).alias("n"), p["alternative_path"].alias("path")))))
    bundle = bundle.withColumns({"_branches": branches, "_paths": paths})

    def on_path(path: Column) -> Column:
        def branch(g: Column, i: Column) -> Column:
            own = F.filter(path, lambda s: s["grp"] == g)
            return F.when(F.size(own) > 0, F.get(own, F.lit(0))["branch"]).otherwise(F.get(F.get("_branches", i), F.lit(0)))

        return F.transform("_groups", branch)

    def grown(chosen: Column, options: Column) -> Column:
        longer = F.flatten(F.transform(chosen, lambda c: F.transform(options, lambda b: F.concat(c, F.array(b)))))
        return F.slice(longer, 1, limit)  # in order, so what is cut comes after all that is kept

    start = F.array(F.array().cast("array<int>"))
    every = F.aggregate("_branches", start, grown)
    defaults = F.array(F.transform("_branches", lambda b: F.get(b, F.lit(0))))
    picked = F.slice(F.array_distinct(F.concat(defaults, F.transform("_paths", lambda p: on_path(p["path"])), every)), 1, limit)
    product = F.aggregate("_branches", F.lit(1.0), lambda n, b: n * F.size(b))
    chosen = bundle.select(*key, "_parts", "_groups", (product > limit).alias("truncated"), F.posexplode(picked).alias("_ord", "_choice"))

    def rendered(p: Column) -> Column:
        return F.forall(p["alternative_path"], lambda s: F.get("_choice", (F.array_position("_groups", s["grp"]) - 1).cast("int")) == s["branch"])

    shown = chosen.withColumn("_shown", F.filter("_parts", rendered))
    body = F.trim(F.array_join(F.transform("_shown", lambda p: p["content"]), "\n"))
    views = shown.select(*key, "_ord", "truncated", body.alias("body"), F.exists("_shown", lambda p: p["uncertain"]).alias("uncertain"))
    once = views.groupBy(*key, "body").agg(F.min("_ord").alias("_ord"), F.bool_and("uncertain").alias("uncertain"), F.first("truncated").alias("truncated"))
    # At most `limit` views share a message.
    return once.withColumn("view", F.row_number().over(Window.partitionBy(*key).orderBy("_ord"))).select(*key, "view", "body", "uncertain", "truncated")
