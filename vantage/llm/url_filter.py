"""URL filters: rules by host and path, and a naive Bayes model over segmented host and path words.

Unigram counts come from the hosts and paths of the whole table, beside seed words: in how many places separators show a
word. Viterbi splits each name into the likeliest words. All counts stay in tables. Pages whose words hold a block seed and no allow seed count as examples to block, the others as examples
to allow; a multinomial model of all words of both classes then judges every page that no rule decides.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.runtime import discard, settle

# no word inside a name is longer; a whole name may be a word of any length
LONGEST_WORD = 32

# fixed values: rules in the order (verdict, host/path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# fixed values: seed words of the two classes
BLOCK_SEEDS = """ad ads adult advert adverts affiliate bet bets betting bingo bonus bride brides cam cams cash casino casinos
cheap cialis click clicks coin crack cracked credit dating deal deals debt diet discount drug drugs earn escort escorts
farm free gamble gambling gift hack hacks hot jackpot keygen loan loans lottery lucky malware meds money naked nude offer
offers payday pharma pharmacy phish phishing pill pills pirate poker popup porn porno prize promo proxy replica rich scam
sex sexy slot slots spam spyware sweepstakes track tracker tracking tube viagra virus warez weight win winner winners
wins x xxx""".split()
ALLOW_SEEDS = """academy api app archive art article articles blog book books city code college community company data dev
docs edu education forum garden guide guides health help history home journal kitchen learn library life magazine mail
map maps math media museum music nature news paper papers people photo photos press project recipe recipes research
review reviews school science shop site software sport sports status store stories story studio support team tech travel
tutorial university weather web wiki work world""".split()
# words so general that they mark a page only beside a second block seed
WEAK = frozenset("ad click coin credit deal deals debt diet farm free gift hot money offer offers rich track tube weight win wins x".split())


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


class Words:
    """Unigram model: the likeliest split of a name into words and unknown runs of letters, of any length."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.counts = counts
        self.total = total or sum(counts.values()) or 1
        self.widths = sorted({len(w) for w in counts})

    def _word(self, w: str, whole: bool) -> float:
        # words of 3 letters are in many names by chance, shorter ones in all
        if w in self.counts and (whole or len(w) > 2):
            return math.log(self.counts[w] / self.total) - (0.0 if whole or len(w) > 3 else 6.5)
        return -math.inf

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        run = (-math.inf, 0)  # the best split that ends in an unknown run, and where the run starts; its letters are alike
        for j in range(1, len(name) + 1):
            run = max((best[j - 1] - 7.2, j - 1), (run[0] - 3.2, run[1]))
            some = [(best[j - n] + self._word(name[j - n : j], n == len(name)), j - n) for n in self.widths if n <= j]
            score, i = max([run, *some])
            best.append(score)
            back.append(i)
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return out[::-1]


def names_of(column: str) -> Column:
    """Runs of letters, and # for each run of digits."""
    return F.transform(F.regexp_extract_all(column, F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\p{Nd}"), "#").otherwise(x))


_BLOCK, _ALLOW = frozenset(BLOCK_SEEDS), frozenset(ALLOW_SEEDS)


def lexicon(rows: DataFrame, made: list[DataFrame] | None = None) -> tuple[DataFrame, int]:
    """(word, c) of the words that names are split into, and the sum of c. rows: (host, path).

    c: in how many places beside its own one a name stands between separators, so that no host, however many pages it
    has, makes its name a word. A host label's place is what follows the label; a path name's is the host, unless that
    holds the name. Seeds are words of their own.
    """
    labels = rows.select("host").distinct().select("host", F.posexplode(F.split("host", r"\.")).alias("at", "label"))
    after = F.expr("substring_index(host, '.', at + 1 - size(split(host, '[.]')))")
    hosts = labels.select(F.explode(names_of("label")).alias("word"), F.xxhash64(after, F.lit("h")).alias("place"))
    paths = rows.select("host", F.explode(F.array_distinct(names_of("path"))).alias("word")).filter(~F.contains("host", "word"))
    places = hosts.unionByName(paths.select("word", F.xxhash64("host", F.lit("p")).alias("place"))).filter(F.col("word") != "#").distinct()
    found = settle(places.groupBy("word").agg((F.count("*") - 1).alias("c")).filter("c > 0"), "words")
    total = found.agg(F.sum("c")).head()[0] or 0
    share = max(1, total // 20_000)
    seeds = [(w, share * (1 if len(w) < 3 else 10)) for w in (*BLOCK_SEEDS, *ALLOW_SEEDS)]
    more = rows.sparkSession.createDataFrame(seeds, "word string, c long")
    words = settle(found.unionByName(more).groupBy("word").agg(F.sum("c").alias("c")), "words")
    discard(found)
    if made is not None:
        made.append(words)
    return words, total + sum(c for _, c in seeds)


def splits(rows: DataFrame) -> DataFrame:
    """(key, value): every name of the hosts and paths with its words.

    Names meet the counts of their substrings of up to LONGEST_WORD letters, and of the whole name, in a join, so no part of the lexicon is
    left out and a name's rows grow with its length. A word that other words make up,
    all of them of four letters or more common than it, is a compound and doesn't count as a word; seeds always do.
    """
    made: list[DataFrame] = []
    known, total = lexicon(rows, made)
    names = settle(rows.select(F.explode(F.concat(names_of("host"), names_of("path"))).alias("name")).distinct().withColumn("id", F.md5("name")), "names")
    lengths = sorted(r.n for r in known.select(F.length("word").alias("n")).filter((F.col("n") > 2) & (F.col("n") <= LONGEST_WORD)).distinct().collect())  # at most as many as a word's letters

    def parts(batches):
        ids, found = [], []
        for batch in batches:
            for key, name in zip(batch.column("id").to_pylist(), batch.column("name").to_pylist(), strict=True):
                some = {name, *(name[k : k + n] for n in lengths for k in range(len(name) - n + 1))}
                ids += [key] * len(some)
                found += some
                while len(found) >= 10_000:
                    yield pa.record_batch({"id": pa.array(ids[:10_000], pa.string()), "word": pa.array(found[:10_000], pa.string())})
                    del ids[:10_000], found[:10_000]
        yield pa.record_batch({"id": pa.array(ids, pa.string()), "word": pa.array(found, pa.string())})

    held = settle(names.mapInArrow(parts, "id string, word string").join(known, "word").select("id", "word", "c"), "held")

    def compounds(batches):
        for batch in batches:
            out = []
            for name, held in zip(batch.column("name").to_pylist(), batch.column("held").to_pylist(), strict=True):
                counts = {x["word"]: x["c"] for x in held}
                own = counts.pop(name, 0)
                found = Words(counts, total).split(name) if own and name not in _BLOCK and name not in _ALLOW else []
                if len(found) > 1 and all(x in counts and (len(x) > 3 or counts[x] > own) for x in found):
                    out.append(name)
            yield pa.record_batch({"word": pa.array(out, pa.string())})

    def split(batches):
        for batch in batches:
            names = batch.column("name").to_pylist()
            out = [[n] if n == "#" else Words({x["word"]: x["c"] for x in held or ()}, total).split(n) for n, held in zip(names, batch.column("held").to_pylist(), strict=True)]
            yield pa.record_batch({"key": pa.array(names, pa.string()), "value": pa.array(out, pa.list_(pa.string()))})

    gathered = F.collect_list(F.struct("word", "c")).alias("held")
    joined = settle(names.join(held.groupBy("id").agg(gathered), "id").select("name", "held").mapInArrow(compounds, "word string"), "compounds")
    plain = names.join(held.join(joined, "word", "left_anti").groupBy("id").agg(gathered), "id", "left").select("name", "held")
    out = settle(plain.mapInArrow(split, "key string, value array<string>"), "splits")
    for x in (*made, names, held, joined):
        discard(x)
    return out


def look_up(keys: DataFrame, table: DataFrame, often: int = 10_000, made: list[DataFrame] | None = None) -> DataFrame:
    """(row, key, value) for each of the keys (row, key), all of which are in table (key, value).

    The keys that most rows have are broadcast; the others, each on few rows, are joined. The table that the result reads is
    added to `made`.
    """
    top = keys.groupBy("key").count().orderBy(F.desc("count"), "key").limit(often).select("key")
    near = settle(table.join(top, "key", "left_semi").withColumn("near", F.lit(True)), "near")
    if made is not None:
        made.append(near)
    first = keys.join(F.broadcast(near), "key", "left")
    far = first.filter(F.col("near").isNull()).select("row", "key").join(table, "key")
    return first.filter("near").select("row", "key", "value").unionByName(far.select("row", "key", "value"))


def learn(words: DataFrame, bad: DataFrame) -> tuple[DataFrame, float]:
    """(key, value): the log ratio (block to allow) of every word, and that of the classes.

    words: (row, key), with the words marked by place; bad: (row, bad), whether the page is an example to block.
    """
    own = words.join(bad, "row").groupBy("key").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("a"))
    counts = settle(own, "word_classes")
    pages = bad.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).head()
    # seeds count a tenth of what their class holds, and smoothing stays small, so that few pages suffice
    tokens = [max(1.0, x or 0) for x in counts.agg(F.sum("b"), F.sum("a")).head()]
    seeds = [("h:" + w, 0.1 * tokens[0] / len(BLOCK_SEEDS), 0.0) for w in BLOCK_SEEDS] + [("h:" + w, 0.0, 0.1 * tokens[1] / len(ALLOW_SEEDS)) for w in ALLOW_SEEDS]
    more = words.sparkSession.createDataFrame(seeds, "key string, b double, a double")
    both = counts.unionByName(more).groupBy("key").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    nb, na, v = both.agg(F.sum("b"), F.sum("a"), F.count("*")).head()
    ratio = F.log((F.col("b") + 0.1) / (nb + 0.1 * v)) - F.log((F.col("a") + 0.1) / (na + 0.1 * v))
    out = settle(both.select("key", ratio.alias("value")), "ratios")
    discard(counts)
    return out, math.log((pages[0] + 1) / (pages[1] + 1))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each page.

    score: log odds of block to allow by the model; the verdict is the rule's where one fits, else block where score > 0.
    Cases: a null url or one without :// has an empty host and path and is allowed unless the classes' odds say block;
    repeated rows are judged each, alike; odds that tie allow; urls of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = settle(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    named = rows.select("row", "host", F.lower("path").alias("path"))
    kinds = [named.select("row", F.lit(k).alias("kind"), F.explode(names_of(c)).alias("key")) for k, c in (("h:", "host"), ("p:", "path"))]
    # a name's place stays with its row's number while it is looked up
    marked = kinds[0].unionByName(kinds[1]).select(F.struct("row", "kind").alias("row"), "key")
    made = [splits(named)]
    found = look_up(marked, made[0], made=made)
    words = settle(found.select("row.row", F.col("row.kind").alias("kind"), F.explode("value").alias("word")), "page_words")
    for x in made:
        discard(x)
    block, allow = F.col("word").isin(*_BLOCK), F.col("word").isin(*_ALLOW)
    seeds = words.filter(block | allow).groupBy("row").agg(F.collect_set("word").alias("seeds"))
    is_block = lambda x: x.isin(*_BLOCK)
    looks = F.exists("seeds", lambda x: is_block(x) & ~x.isin(*WEAK)) | (F.size(F.filter("seeds", is_block)) > 1)
    bad = rows.select("row").join(seeds, "row", "left").select("row", F.coalesce(looks & ~F.exists("seeds", lambda x: x.isin(*_ALLOW)), F.lit(False)).alias("bad"))
    keys = words.select("row", F.concat("kind", "word").alias("key"))
    classes = settle(bad, "page_classes")
    ratios, prior = learn(keys, classes)
    made = [words, classes, ratios]
    sums = settle(look_up(keys, ratios, made=made).groupBy("row").agg(F.sum("value").alias("sum")), "page_sums")
    for x in made:
        discard(x)
    # sums are rounded, for their order is open
    scored = rows.join(sums, "row", "left").withColumn("score", F.round(F.lit(prior) + F.coalesce("sum", F.lit(0.0)), 9))
    ruled = scored.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"), "score")
