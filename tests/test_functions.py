"""Tables of expected values, worked out by hand, and properties."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge.config import Settings, validate_worker
from corpusforge.functions import answers, clean, ids, text, urls
from corpusforge.operators import chunking, context, families, filters, lookup, metadata
from corpusforge.plans import judge, qa, search
from corpusforge.sources import readers, writers
from corpusforge.sources.tables import documents


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("step", "given_", "expected"),
    [
        (clean.ground_terms, "a (10)(2e) b 5.1.2i c", "a  b  c"),
        (clean.email_addresses, "jan@test.ni", "@test.nl"),
        (clean.email_addresses, "From: $@test.nl", "From: @test.nl"),
        (clean.email_addresses, "@ test.nl", "@test.nl"),
        (clean.doubled_word, "This dubbel  DUBBEL sentence", "This  sentence"),
        (clean.markdown_marks, "**a** *b* _c_ `d`", "a b c d"),
        (clean.excess_newlines, "a  \n\n\n\nb\n\n\n", "a\n\nb\n\n"),
        (clean.excess_newlines, "a\n", "a\n"),
        (clean.empty_brackets, "some [] ( ) {\n} here", "some    here"),
        (clean.punctuation, "Hello , World... ok,, no !", "Hello, World. ok, no!"),
        (clean.double_space, "a \n\n b", "a b"),
        (clean.short_words, "de één dag is lang", " één dag  lang"),
        (clean.pdf_text, "a  b\tc 1.2a\n \nd", "a b c  1.2a \n\n\n\nd"),
    ],
)
def test_clean(spark, step, given_, expected):
    assert one(spark, step, given_) == expected


@pytest.mark.parametrize(("given_", "expected"), [("(A) x", "(A) x"), ("(abc) x", "abc x"), ("(abcdefghij)", "(abcdefghij)"), ("a) b", "a b"), ("(a b", "a b"), ("([abc])", "(abc)"), ("", "")])
def test_balance(given_, expected):
    assert clean.balance(given_) == expected


@given(st.text(alphabet="ab ()[]{}<>", max_size=40))
@settings(max_examples=200, deadline=None)
def test_balance_leaves_other_signs(value):
    keep = [c for c in value if c not in "()[]{}<>"]
    assert [c for c in clean.balance(value) if c not in "()[]{}<>"] == keep


def test_clean_whole(spark):
    rows = spark.createDataFrame([("", "Email"), ("ab", None), ("From: x\nThis is the body of it", "email"), ("A longer text of words", None), (None, "PDF")], "x string, k string")
    got = [r["y"] for r in rows.select(clean.clean(F.col("x"), F.col("k")).alias("y")).collect()]
    assert got[0] is None and got[1] is None and got[4] is None
    assert "From" not in got[2] and "body" in got[2] and "longer" in got[3]


@pytest.mark.parametrize(
    ("value", "first", "last"),
    [("op 1 januari 2023 en 31-12-2024", "2023-01-01", "2024-12-31"), ("31-2-2020", "2020-02-01", "2020-02-01"), ("in 05-2021", "2021-05-01", "2021-05-01"), ("05-2021 en 1/6/2022", "2022-06-01", "2022-06-01"), ("1-1-1949", None, None), ("", None, None)],
)
def test_dates(spark, value, first, last):
    got = one(spark, lambda c: text.mentioned_dates(c, 2026), value)
    assert (got["first"] and str(got["first"]), got["last"] and str(got["last"])) == (first, last)


def test_subject(spark):
    assert one(spark, text.subject, "x Betreft: de zaak\nmeer") == "de zaak"
    assert one(spark, text.subject, "niets") is None


@pytest.mark.parametrize(
    ("value", "issue"),
    [("l l l l l l l l l l", "potential_ocr_errors"), ("", "empty_content"), ("[] [] []", "ocr_artifacts"), ("![](_page_0/page/1.png)", "image_only"), ("a\n\n\n\n\n\n\nb", "excessive_newlines"), ("short", "very_short_content")],
)
def test_quality(spark, value, issue):
    assert issue in one(spark, text.markdown_issues, value)


def test_quality_of_good_text(spark):
    assert one(spark, text.markdown_issues, "# Title\n\nThis is a good text with plenty of words in its lines.\nAnd a second line.") == []


def test_sentences(spark):
    assert one(spark, text.sentences, "Hi Mr. Smith. See a.b. now? Yes!") == ["Hi Mr. Smith.", "See a.b. now?", "Yes!"]


def reference_chunks(parts, length, ideal=1000, share=0.05):
    """Written apart from the engine's fold, list by list."""
    target = length / max(1, round(length / ideal))
    chunks, now, size, tail = [], [], 0, []
    for p in parts:
        now, size = [*now, p], size + len(p) + 1
        if size >= target:
            chunks.append(" ".join(now))
            tail, n = [], 0
            for s in now[::-1]:
                tail, n = [s, *tail], n + len(s) + 1
                if n >= int(target * share):
                    break
            now, size = list(tail), n
    return chunks + ([" ".join(now)] if now and (not chunks or now != tail) else [])


def test_fold():
    rng = random.Random(3)
    for _ in range(200):
        parts = ["w" * rng.randrange(0, 120) for _ in range(rng.randrange(1, 60))]
        n = len(" ".join(parts))
        target = n / max(1, round(n / 300))
        got, want = chunking.fold_sentences(parts, target, int(target * 0.05)), reference_chunks(parts, n, 300)
        assert got == want or len(set(parts)) < len(parts)


def test_chunks_cover(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = docs.select("content", text.sentences(F.col("content")).alias("s"), chunking.naive(F.col("content")).alias("c")).collect()
    for r in rows:
        assert all(any(s in c for c in r["c"]) for s in r["s"])
        assert r["c"] == reference_chunks(r["s"], len(r["content"]))


@pytest.mark.parametrize(("value", "expected"), [("10-264352", "264352"), (None, ""), ("", ""), ("abc", "abc")])
def test_normalize(spark, value, expected):
    assert one(spark, ids.normalize_id, value) == expected


@pytest.mark.parametrize(("value", "expected"), [("10-264352", "10264352"), ("0202227", "202227"), (None, None), ("", "")])
def test_family_id(spark, value, expected):
    assert one(spark, ids.family_id, value) == expected


@pytest.mark.parametrize(("value", "expected"), [(None, True), ("", True), ("nan", True), ("None", True), ("valid-uuid", False), ("123", False)])
def test_missing(spark, value, expected):
    assert one(spark, ids.is_missing, value) is expected


def test_uuid(spark):
    import hashlib
    import json
    import uuid

    content, link = "héllo " * 40, 'https://x.org/"a"'
    meta = json.dumps({"vws_id": "", "link": link, "title": "", "content_hash": hashlib.md5(content[:100].encode()).hexdigest()}, sort_keys=True)
    expected = str(uuid.UUID(bytes=hashlib.sha256(meta.encode()).digest()[:16]))
    got = spark.createDataFrame([(content, link)], "c string, l string").select(ids.document_uuid(F.col("c"), F.col("l")).alias("u")).first()["u"]
    assert got == expected


def test_chunk_id(spark):
    import uuid

    u = uuid.uuid5(uuid.NAMESPACE_URL, "x")
    assert one(spark, lambda c: ids.chunk_id(c, F.lit(5)), str(u)) == ((u.int & ((1 << 46) - 1)) << 17) | 5


@pytest.mark.parametrize(("value", "expected"), [("a: b  c", "a__b_c.pdf"), ("x.docx", "x.docx"), ("n" * 120, "n" * 96 + ".pdf")])
def test_file_name(spark, value, expected):
    assert one(spark, ids.file_name, value) == expected


@pytest.mark.parametrize(
    ("value", "text_", "ids_"),
    [("a [5] b [2,5]", "a [2] b [1,2]", ["c2", "c5"]), ("none", "none", [f"c{i}" for i in range(1, 7)]), ("[9] [0]", "[2] [1]", ["missing_chunk_0", "missing_chunk_9"]), ("[x] [1] [", "[x] [1] [", ["c1"])],
)
def test_citations(spark, value, text_, ids_):
    have = F.array(*[F.lit(f"c{i}") for i in range(1, 7)])
    assert one(spark, answers.renumber, value) == text_
    assert one(spark, lambda c: answers.cited_ids(c, have), value) == ids_


@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
@settings(max_examples=10, deadline=None)
def test_citations_are_dense(spark, numbers):
    got = one(spark, lambda c: answers.citation_numbers(answers.renumber(c)), " ".join(f"[{n}]" for n in numbers))
    assert got == list(range(1, len(set(numbers)) + 1))


def test_packed_ids(spark):
    assert one(spark, answers.decompress_ids, "a,b") == ["a", "b"]


def test_between_marks(spark):
    assert one(spark, lambda c: answers.between_marks(c, "<a>", "</a>"), "x <a> y </a> z </a> w") == "y </a> z"
    assert one(spark, lambda c: answers.between_marks(c, "<a>", "</a>"), " plain ") == "plain"


def test_host(spark):
    assert one(spark, urls.host, "https://www.a.org:80/x?y") == "a.org:80"
    assert one(spark, urls.host, "nothing") == ""
    assert one(spark, urls.is_excluded, "https://www.outlook.com/x") is True


def test_absolute(spark):
    assert one(spark, lambda c: urls.absolute(c, F.lit("https://a.org/b/c")), "../d") == "https://a.org/d"


def test_filters():
    assert filters.SearchFilter.from_request("bad", None, None) is None
    assert filters.SearchFilter.from_request("2020-01-01", "bad", ["PDF"]).types == ("PDF",)
    assert filters.at_least_one(0) == 1


def test_admit_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([40, 50, 30, 1])] + [(2, 0, 500), (2, 1, 1)], "query_id int, pos int, tokens int")
    assert sorted((r["query_id"], r["pos"]) for r in context.admit(rows, 100).collect()) == [(1, 0), (1, 1)]


def test_families_stay_together(spark):
    rows = spark.createDataFrame([(f"d-{i}", f"family-{i // 3 + 1}") for i in range(20)], "ID string, Family string")
    got = families.split_by_family(rows, 4).collect()
    assert len(got) == 20 and len({(r["Family"], r["worker"]) for r in got}) == len({r["Family"] for r in got})
    sizes = sorted(r["count"] for r in families.split_even(rows, 6).groupBy("worker").count().collect())
    assert sum(sizes) == 20 and sizes[-1] - sizes[0] <= 1


def test_attachment(spark):
    rows = spark.createDataFrame([("# Main Document\nThis references Test Doc 2\nMore content", "C", "Test Doc 2"), ("# Main", "C", "Absent"), ("# Main", "", "Main")], "b string, c string, n string")
    got = [r["t"] for r in rows.select(families.insert_attachment(F.col("b"), F.col("c"), F.lit("7"), F.col("n"), F.lit("L")).alias("t")).collect()]
    assert got[0].startswith("# Main Document\nThis references Test Doc 2\n\n\nBegin Attachment: 7, Test Doc 2, L\n\nC") and got[0].endswith("\nMore content")
    assert got[1].endswith("End Attachment: 7, Absent, L\n") and got[2] == "# Main"


def test_merge_columns(spark):
    rows = spark.createDataFrame([("Test Doc 1", "Test Doc 1_alt"), ("a", "a"), (None, None)], "a string, b string")
    assert [r["m"] for r in rows.select(metadata.merge_columns(F.col("a"), F.col("b")).alias("m")).collect()] == ["Test Doc 1, Test Doc 1_alt", "a", None]


def test_project_needs_its_columns(spark):
    with pytest.raises(ValueError, match="document_id"):
        metadata.project(spark.createDataFrame([("x",)], "besluit_id string"))


def test_settings():
    with pytest.raises(ValueError, match="batch_size"):
        validate_worker({"a": {"metadata_path": "x", "output_dir": "y", "batch_size": 0}})
    with pytest.raises(ValueError, match="output_format"):
        validate_worker({"metadata_path": "x", "output_dir": "y", "output_format": "pdf"})
    assert validate_worker({"paths": {"metadata_path": "x", "output_dir": "y"}})["output_format"] == "markdown"
    with pytest.raises(ValueError, match="max_rounds"):
        Settings(max_rounds=0)


def test_reply_without_a_part_is_null(spark):
    schema = "status string, reasoning string"
    assert one(spark, lambda c: judge.replies(c, schema, ("status", "reasoning")), '{"status": "READY", "reasoning": "x"}')["status"] == "READY"
    assert one(spark, lambda c: judge.replies(c, schema, ("status", "reasoning")), '{"status": "READY"}') is None
    assert one(spark, lambda c: judge.replies(c, schema, ("status", "reasoning")), "no json") is None


def test_lookup_raises(spark):
    wanted = spark.createDataFrame([(0, "a"), (1, "z"), (2, "a")], "pos int, k string")
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    assert [r["v"] for r in lookup.ordered(wanted, rows, "k").collect()] == [1, None, 1]
    with pytest.raises(Exception, match="not found: z"):
        lookup.ordered(wanted, rows, "k", strict=True).collect()


def test_documents_of_files(spark, tmp_path):
    folder = tmp_path / "src" / "docs"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"uuid": "u", "vws_id": "1", "create_date": "10/25/2021 4:56 PM UTC", "type": "PDF", "link": "l", "attachment_links": "[\'x\', \'y\']", "content": "c"}')
    (folder / "b.json").write_text("{broken")
    (folder / "c.json").write_text('{"uuid": "v", "vws_id": "2", "create_date": "nan", "type": "PDF", "link": null, "content": "c"}')
    (tmp_path / "src" / "description.txt").write_text("the source\n")
    got = readers.documents(spark, str(folder)).collect()
    assert [(r["uuid"], str(r["create_date"]), r["attachment_links"]) for r in got] == [("u", "2021-10-25 16:56:00", ["x", "y"])]
    docs, sources = readers.sources(spark, str(tmp_path))
    assert {r["source"] for r in docs.collect()} == {"src"} and [tuple(r) for r in sources.collect()] == [("src", "the source")]


def test_metadata_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "m", "f", 'a "b", c', "pdf", "d", "l", "b", True)], readers.METADATA)
    writers.metadata(rows, str(tmp_path / "m"))
    assert readers.metadata(spark, str(tmp_path / "m")).collect() == rows.collect()


def test_abbreviations(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"AB": "a b"}')
    assert readers.abbreviations(spark, str(tmp_path / "a.json")) == {"AB": "a b"}
    assert readers.abbreviations(spark, str(tmp_path / "absent.json")) == {}


def test_find_filters_after_the_top(spark, sf_dir):
    from corpusforge.plans import index

    docs = documents(spark, sf_dir)
    made = index.build(docs)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("doc"), "content")
    questions = docs.where("doc_id = 3").select(F.col("doc_id").alias("query_id"), F.substring("content", 1, 200).alias("text"))
    plain = docs.select(F.col("doc_id").alias("doc"), "type", "create_date")
    small = Settings(initial_documents_k=1)
    nothing = search.find(made, plain, chunks, questions, small, filters.SearchFilter(types=("No such type",)))
    assert nothing.count() == 0
    found = search.find(made, plain, chunks, questions, small)
    assert [r["doc"] for r in found.collect()] == [3]
    answer = qa.compose(qa.relevant_context(nothing, chunks, questions, judge.RuleJudge(), 100), questions).first()
    assert answer["answer"] == qa.NO_INFORMATION and answer["chunk_ids"] == []
    standard = qa.answer_standard(made, plain, chunks, questions, small)
    assert qa.invariants(standard, found, plain).count() == 0


def test_search_takes_tokenizer_embedder_and_scorer(spark):
    """By hand: vectors choose other chunks than shared words, a scorer ranks those, and pairs without a score come last."""
    from corpusforge.plans import index

    docs = spark.createDataFrame([(1, "ab-cd ab", "t"), (2, "ab xx", "t"), (3, "zz", "t")], "doc_id long, content string, type string").withColumn("create_date", F.lit(None).cast("timestamp"))
    letters = lambda c: F.split(F.regexp_replace(c, "[^a-z]", ""), "")
    made = index.build(docs, tokenize=letters)
    assert {r["term"] for r in made.terms.collect()} == set("abcdxz")
    questions = spark.createDataFrame([(7, "ab")], "query_id long, text string")
    top = search.bm25(made, questions, 10).collect()
    assert [(r["doc"], r["rank"]) for r in top] == [(1, 1), (2, 2)]
    plain, chunks = docs.withColumnRenamed("doc_id", "doc").select("doc", "type", "create_date"), docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("doc"), "content")
    run = lambda **more: [r["chunk_id"] for r in search.find(made, plain, chunks, questions, **more).orderBy("rank").collect()]
    by_x = lambda c: F.when(F.contains(c, F.lit("x")) | (c == "ab"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    assert run() == [1, 2]
    assert run(embed=by_x) == [2, 1]
    assert run(embed=by_x, score=lambda q, c: F.length(c).cast("double")) == [1, 2]
    assert run(embed=by_x, score=lambda q, c: F.when(F.contains(c, F.lit("-")), F.lit(0.0))) == [1, 2]
    assert run(embed=by_x, score=lambda q, c: F.lit(None).cast("double")) == [2, 1]
    answer = qa.answer_standard(made, plain, chunks, questions, embed=by_x).first()
    assert answer["chunk_ids"] == [2, 1]
    rounds = qa.answer_adaptive(made, plain, chunks, questions, Settings(max_rounds=1)).first()
    assert rounds["status"] == "READY" and rounds["subqueries"] == ["ab"] and rounds["rounds"] == 1


def test_training_pairs_lack_nothing(spark, tmp_path):
    at = tmp_path / "pairs.json"
    at.write_text('{"pairs": [{"query": "q", "chunk": "c"}]}')
    assert readers.training_pairs(spark, str(at)).collect() == [("q", "c")]
    at.write_text('[{"query": "q", "chunk": "c"}, {"query": "q"}]')
    with pytest.raises(Exception, match="lacks its query or its chunk"):
        readers.training_pairs(spark, str(at)).collect()


def test_plan_prunes_and_pushes(spark, sf_dir):
    plan = filters.apply(documents(spark, sf_dir), filters.SearchFilter(types=("PDF",))).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


def test_worker_file(tmp_path):
    from corpusforge import config

    at = tmp_path / "worker.yaml"
    at.write_text("paths:\n  metadata_path: m.csv\n  output_dir: out\nbatch_size: 3\n")
    assert config.load_worker(str(at)) == {"batch_size": 3, "output_format": "markdown", "metadata_path": "m.csv", "output_dir": "out"}
    assert config.load_worker(str(at), {"batch_size": 7, "output_dir": None})["batch_size"] == 7
    at.write_text("batch_size: 3\n")
    with pytest.raises(ValueError):
        config.load_worker(str(at))


def test_reserved_tokens():
    from corpusforge.functions import answers

    assert answers.reserved_tokens("x" * 40, "x" * 401) == 350 and answers.reserved_tokens() == 250


def test_pages_of_lenient_hosts(spark):
    """A page of the government with a download button is worth converting however little it says."""
    from pyspark.sql import functions as F

    from corpusforge.functions import pages

    area = '<div class="content">short</div>'
    button = '<a class="m-button big" href="/downloads/document/7">x</a>'
    rows = [(1, "https://a.overheid.nl/x", area + button), (2, "https://a.overheid.nl/x", area), (3, "https://b.org/x", area + button), (4, "https://a.overheid.nl/login", area + button), (5, "https://a.overheid.nl/x", "<p>no area</p>" + button)]
    df = spark.createDataFrame(rows, "i int, url string, html string").withColumn("a", pages.content_area(F.col("html")))
    assert [r["i"] for r in df.where(pages.worth_converting(F.col("a"), F.col("url"))).collect()] == [1]
