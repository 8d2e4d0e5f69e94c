import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD, sample
from repoloom.llm import decontaminate, language, secrets, sharding

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def order(rows):
    return sorted(rows, key=repr)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_by_hand(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    found |= own
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), names, bool(hit)))
    return order(out)


def hits(docs, items):
    return order(tuple(r) for r in decontaminate.contamination(docs, items).drop("item_ids", "row_key").collect())


@pytest.fixture
def items(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, window string")

    return make


def planted(spark):
    tests = [(r.item_id, r.text) for r in sample(spark, "benchmark").collect()]
    tests += [(900, "Rare short item"), (901, "one"), (902, ""), (903, None), (None, "x y z q"), (904, "é ß 🙂 日本")]
    tests += [(905, tests[0][1]), (905, tests[0][1]), (906, "the the the the the the the the the the the")]
    rand = random.Random(5)
    rows = [(r.doc_id, r.text) for r in sample(spark).collect()] + ODD
    for i in range(60):
        own = words(rand.choice(tests)[1])
        at = rand.randrange(max(len(own) - 11, 1))
        rows.append((5000 + i, "Lorem ipsum " + "-".join(own[at : at + rand.randrange(8, 25)]) + "! dolor"))
    rows += [(6000, "a RARE, short\nitem; x y z q"), (6001, "the " * 40), (6002, "日本 é ß 🙂 日本 é"), (6002, "one")]
    return rows, tests


def test_contamination_equals_brute_force(spark, documents, items):
    rows, tests = planted(spark)
    assert hits(documents(rows), items(tests)) == hits_by_hand(rows, tests)


def test_contamination_without_broadcasts(spark, documents, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rows, tests = planted(spark)
    assert hits(documents(rows), items(tests)) == hits_by_hand(rows, tests)


def test_contamination_of_empty_tables(documents, items):
    assert hits(documents([]), items([(1, "a b c")])) == []
    none = hashlib.sha256(b"").hexdigest()
    assert hits(documents([(1, "a b c")]), items([])) == [(1, 3, 0, 0, none, False)]


def test_contamination_runs_no_python(spark, documents, items):
    found = decontaminate.contamination(documents([(1, "a b c")]), items([(1, "b c")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("Scan")[0])


def test_proximity_allows_gaps(documents, items):
    docs = documents([(1, "alpha beta x gamma delta"), (2, "alpha " + "y " * 20 + "beta gamma delta"), (3, "alpha beta gamma delta")])
    found = decontaminate.matches(docs, items([(1, "alpha beta gamma delta")]), slop=2)
    assert order((r.doc_id, r.kind) for r in found.select("doc_id", "kind").distinct().collect()) == [
        (1, "proximity"),
        (3, "phrase"),
    ]


def spans_by_hand(text):
    """The base patterns as they are stated: greedy matches, failing ones dropped."""
    text = text or ""
    out = []
    assign = """(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


SECRETS = [
    (1, 'Password: "hunter2hunter2" and é token=abc, token = Zq8-17.kXw/'),
    (2, "AKIAABCDEFGHIJKL AKIA1 " + "0123456789abcdef" * 3 + "g"),
    (3, "api_key='AKIAABCDEFGHIJKLMN' ſecret=abcdefgh toKen=abcdefgh"),
    (4, "the pwd is x9$Kq!vT2#Lm and the login is password123"),
    (5, "SECRET=changeme secret: aaaaaaaaaaaa"),
    (6, "token: t0ken:x9Kq7vT2wLm4 " * 50),
]


def test_base_spans_equal_the_stated_patterns(spark, documents):
    rows = [(r.doc_id, r.text) for r in sample(spark).collect()] + ODD + SECRETS
    got = secrets.scan(documents(rows)).collect()
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, []).append(spans_by_hand(text))
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in r.spans.split(",") if x and not x.startswith("guess")]
        assert own in want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        counts = Counter(x.split(":")[0] for x in own)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(counts[k] for k in ("assign", "access", "hex"))
        assert (r.redacted is None) == (r.text is None)
    assert secrets.scan(documents([])).count() == 0


PLAIN = secrets.Guesses(secrets.COMMON_WORDS)


def test_dear_values_are_found_and_redacted():
    text = SECRETS[3][1]
    spans = secrets.find_spans(text, PLAIN)
    assert [text[a:b] for a, b, k in spans if k == "guess"] == ["x9$Kq!vT2#Lm"]
    assert secrets.redact(text, spans) == "the pwd is [guess] and the login is password123"


@pytest.mark.parametrize(
    "value",
    ["x9$Kq!vT2#Lm", "9f86d081884c7d659a2feaa0c55ad015", "Tr0ub4dor&3xK", "zqXvB81plw", "kV7/pQ2+sL9=", "xk29-vbq7-ppz4"],
)
@pytest.mark.parametrize("context", ["password: {}", "API_KEY='{}'", "my_token = {}.", "the login is {}", "auth => {}"])
def test_planted_values(value, context):
    text = f"Some prose first; {context.format(value)} and more."
    found = [text[a:b] for a, b, k in secrets.find_spans(text, PLAIN) if k == "guess"]
    assert [x.rstrip(".") for x in found] == [value.rstrip(".")]


PROSE = [
    "The secret is persistence.", "our compass is unreliable", "each token is represented as", "Auth: authentication",
    "password is documentation", "Tokens: representation", "the login is Authoritative", "secretary: Featherstonehaugh1x",
    "passing = straightforward9z", "password: 20240131", "token=qwertyuiop", "pwd: abcabcabcabc", "secret: 11111111111111",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_and_cheap_values_are_left_alone(text):
    assert not [x for x in secrets.find_spans(text, PLAIN) if x[2] == "guess"]


def test_every_value_is_scored_by_the_words_of_the_corpus(spark, documents):
    rows = [(i, "the gribblefrotz sat by a mumblewock, gribblefrotz") for i in range(5)]
    rows += [(10, "token=gribblefrotz-mumblewock"), (11, "token=gribblofrutz-mimblewack"), (12, "xgribblefrotz9 once")]
    words = secrets.corpus_words(documents(rows))
    assert words[len(secrets.COMMON_WORDS) :] == ["gribblefrotz", "mumblewock", "sat", "the"]
    got = {r.doc_id: r for r in secrets.scan(documents(rows)).collect()}
    assert got[10].n_assign == got[11].n_assign == 1
    assert (got[10].n_guess, got[11].n_guess) == (0, 1)
    assert got[11].spans == "assign:0:29,guess:6:29" and got[11].redacted == "[assign]"


def cost_by_hand(value, words_):
    """All segmentations: every cut into parts, every reading of a part."""
    log, low = math.log10, value.lower()
    rows_ = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
    place = {c: (x + y / 2, y) for y, row in enumerate(rows_) for x, c in enumerate(row)}

    def touch(a, b):
        if a == b or a not in place or b not in place:
            return False
        (x, y), (u, v) = place[a], place[b]
        return abs(x - u) <= 1 and abs(y - v) <= 1

    kinds = ((touch, 188), (lambda a, b: abs(ord(a) - ord(b)) == 1, 52), (lambda a, b: a == b, 64))

    def in_run(i, j, joins):
        """Inside a run of three or more."""
        while i > 0 and joins(low[i - 1], low[i]):
            i -= 1
        while j < len(low) and joins(low[j - 1], low[j]):
            j += 1
        return j - i >= 3

    def part(i, j):
        text, small = value[i:j], low[i:j]
        yield 1.0 if j - i == 1 else math.inf
        if re.fullmatch(r"(19|20)\d\d", text):
            yield log(36500)
        for order_ in (r"(19|20)\d\d([-/._]?)(0?[1-9]|1[0-2])\2(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|[12]\d|3[01])([-/._]?)(0?[1-9]|1[0-2])\2(19|20)\d\d"):
            match = re.compile(order_).match(value, i)
            if match and match.end() == j:
                yield log(36500)
        for joins, first in kinds:
            if all(joins(a, b) for a, b in zip(small, small[1:])) and in_run(i, j, joins):
                yield log(first) + 0.1 * (j - i - 1)
        size = j - i
        if 2 <= size <= 16 and low[max(i - size, 0) : i] == small:
            yield log(2 + size)
        plain = small.translate(str.maketrans("4@310$5!7", "aaeiossit"))
        for k, word in enumerate(words_):
            if len(word) >= 3 and word in (small, plain):
                other = word != small and small not in words_
                if word == small or other:
                    yield log(k + 2) + log(2) * other + log(2) * (text != small)

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + min(part(i, j)) for i in range(j)))
    return best[-1]


def test_guess_costs():
    pool = ["horse", "staple", "correct", "hor", "rect", "sat"]
    values_ = [
        "correcthorsexq", "xhorstaplez", "rectcorrect", "qzvkw", "", "C0rrectHORSE", "born1987-03-12x", "x20240131horse",
        "asdfghjk99", "sdfghq", "abcdefzz", "aaaahor", "xyxyxyxy", "horsehorse", "12345678", "qwe123asd", "5@t", "31.12.1999",
    ]
    rng = random.Random(4)
    letters = "horsetaplcq1239.AS"
    values_ += ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(60)]
    values_ += ["".join(rng.choice(["hor", "rect", "123", "qwe", "aa", "19", "x", "Staple", "ab"]) for _ in range(4)) for _ in range(60)]
    for value in values_:
        assert secrets.guess_cost(value, pool) == pytest.approx(cost_by_hand(value, pool)), value


def test_languages_of_held_out_documents(spark):
    docs = sample(spark, scale="sf0.01").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs, ~held)
    assert all(len(x) <= language.DICTIONARY_BYTES for _, x in model.dictionaries)
    found = language.identify(docs.filter(held), model)
    right, rows, kept = found.select(
        F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*"), F.count_if("accepted")
    ).first()
    assert rows > 200 and right >= 0.97 * rows and kept >= 0.97 * rows


def test_languages_of_odd_texts(spark, documents):
    docs = sample(spark).select("doc_id", "text", "lang")
    model = language.fit(docs, F.lit(True))
    got = language.identify(documents(ODD + [(1, "12 34 !?")]), model)
    assert got.count() == len(ODD) + 1 and got.columns[-3:] == ["lang_pred", "score", "accepted"]
    for r in got.collect():
        assert 0 <= r.score <= 1
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.accepted) == ("und", False)
        else:
            assert r.lang_pred in {x for x, _ in model.dictionaries}
    assert language.identify(documents([]), model).count() == 0
    nothing = language.fit(documents([]), F.lit(True))
    assert {r.lang_pred for r in language.identify(documents(ODD), nothing).collect()} == {"und"}


def test_languages_of_equal_sizes_are_rejected(documents):
    same = b"the same words in both dictionaries "
    model = language.Languages((("aa", same), ("bb", same)))
    got = language.identify(documents([(1, "short words"), (2, "the words " * 20)]), model).collect()
    assert [(r.lang_pred, r.score, r.accepted) for r in got] == [("aa", 0.0, False)] * 2


def mixed(spark):
    rows = [(i, f"text {i % 7}", f"s{i % 3}" if i % 2 else "hot") for i in range(500)]
    rows += [(1000, None, None), (1001, "", None), (None, "x", "hot"), (1002, "é🙂", "lone"), (5, "text 5", "s2"), (5, "text 5", "s2")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)


def test_shards_equal_brute_force(spark):
    rows, df = mixed(spark)
    got = sharding.interleaved_shards(df, 8, seed=3).collect()
    name = df.withColumn("h", F.xxhash64(F.lit(3), "doc_id")).collect()
    size = lambda r: len((r.text or "").encode()) + 1
    crc = lambda r: zlib.crc32((r.text or "").encode())
    rank = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    text_rank = lambda x: (x is not None, x or "")
    by_source = {}
    for r in sorted(name, key=lambda r: (r.h, rank(r.doc_id), crc(r), size(r))):
        by_source.setdefault(r.source, []).append(r)
    placed = sorted(
        ((k + 0.5) / len(own), text_rank(s), r.h, rank(r.doc_id), crc(r), size(r), k, r)
        for s, own in by_source.items()
        for k, r in enumerate(own)
    )
    n, want, used = len(placed), [], Counter()
    for p, (*_, r) in enumerate(placed):
        shard = p * 8 // n
        want.append((r.doc_id, r.source, size(r), crc(r), shard, used[shard]))
        used[shard] += 1
    columns = ("doc_id", "source", "size", "text_crc32", "shard", "slot")
    assert order(tuple(r[c] for c in columns) for r in got) == order(want)
    assert max(used.values()) - min(used.values()) <= 1
    for source, own in by_source.items():
        for shard in range(8):
            have = sum(r.shard == shard and r.source == source for r in got)
            assert abs(have - len(own) / 8) < 2


def test_shards_of_few_rows(spark, documents):
    assert sharding.interleaved_shards(documents([]), 8).count() == 0
    got = sharding.interleaved_shards(documents([(1, "a"), (2, "b"), (3, None)]), 8).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (2, 0), (5, 0)]


def test_languages_by_hand(spark, documents):
    """Sizes of whole texts, made anew with the library, and the rule on them."""
    import zstandard

    model = language.fit(sample(spark), ~language.held_out(F.col("doc_id")))
    rows = [(r.doc_id, r.text) for r in sample(spark).limit(120).collect()] + ODD + [(7, "a b"), (8, "word " * 300)]
    rows += [(i, " ".join((t or "").split()[:k])) for i, (_, t) in enumerate(rows[:30]) for k in (1, 3, 8)]
    settings = zstandard.ZstdCompressionParameters.from_level(
        language.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0
    )
    want = []
    for doc_id, text in rows:
        raw = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())).encode()
        sizes = []
        for lang, content in model.dictionaries:
            words_ = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size = 0
            for at in range(0, len(raw), 1024):
                size += len(zstandard.ZstdCompressor(dict_data=words_, compression_params=settings).compress(raw[at : at + 1024]))
            sizes.append((size, len(sizes), lang))
        if not raw:
            want.append((doc_id, "und", 0.0, False))
            continue
        first, second = sorted(sizes)[:2]
        lead = second[0] - first[0]
        want.append((doc_id, first[2], 1 - math.exp(-lead / 2), lead >= 2 and lead > 0.005 * second[0]))
    got = language.identify(documents(rows), model).select("doc_id", "lang_pred", "score", "accepted").collect()
    rounded = lambda rows_: order((i, lang, round(x, 9), a) for i, lang, x, a in rows_)
    assert rounded(tuple(r) for r in got) == rounded(want)
