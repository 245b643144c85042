"""Language, personal data, secrets, decontamination, packing and page text, against brute force, round trips and held-out accuracy."""
from __future__ import annotations

import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patronage.llm import decontaminate, html_text, language, packing, pii, secrets
from patronage.llm.queries import table
from patronage.llm.spans import in_order
from tests.llm.frames import awkward, documents, empty, prose

SMALL = "/root/testdata/sf0.01"


# --- language

def test_language_accuracy_on_held_out_documents(spark):
    docs = table(spark, SMALL, "documents")
    out = language.predict(docs, language.train(docs.select("doc_id", "text", "lang"))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    model = language.train(docs)
    rows = language.predict(docs, model).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_id[i]["lang_pred"] for i in (0, 1, 2, 5)] == ["und"] * 4
    assert set(model.labels) == {"en", "de"} and by_id[6]["lang_pred"] in model.labels
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and {0, 1, 2, 5} & {r["doc_id"] for r in kept.collect()} == set()


def test_language_without_rows_or_labels(spark):
    model = language.train(empty(spark))
    assert model.labels == [] and language.predict(empty(spark), model).count() == 0
    assert {r["lang_pred"] for r in language.predict(documents(spark), model).collect()} == {"und"}


def test_language_training_never_sees_held_out_rows(spark):
    docs = documents(spark, [(i, "abc abc", "xx", *[None] * 10) for i in range(40)])
    held = {r["doc_id"] for r in docs.select("doc_id", language.held_out(docs["doc_id"]).alias("h")).where("h").collect()}
    import zlib
    assert held == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2}
    rows = [(i, "abc" if i not in held else "zzz", "xx" if i not in held else "yy", *[None] * 10) for i in range(40)]
    assert language.train(documents(spark, rows)).labels == ["xx"]


def test_language_scores_are_sums_over_all_grams(monkeypatch):
    model = language.LanguageModel(["a", "b"], np.random.default_rng(0).normal(size=(2, 1 << 8)).astype("float32"), np.zeros(2), 8)
    text = prose(random.Random(2), 200)
    want = np.array([sum(line[np.concatenate(list(language.buckets(text, 8, (1, 2, 3))))].astype(float)) for line in model.log_prob])
    assert language.log_scores([text, text], model)[1] == pytest.approx(want)
    whole = np.sort(np.concatenate(list(language.buckets(text, 8, (1, 2, 3)))))
    monkeypatch.setattr(language, "BLOCK", 50)
    assert (np.sort(np.concatenate(list(language.buckets(text, 8, (1, 2, 3))))) == whole).all()
    assert len(whole) == 3 * len(text) - 3


# --- personal data

def brute_pii(text: str) -> list:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return in_order(out, pii.KINDS)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-123 +(4%", max_size=40) | st.text(alphabet="0123456789 -", min_size=10, max_size=60))
def test_base_personal_data_against_plain_patterns(text):
    assert pii.found(text) == brute_pii(text)


@pytest.mark.parametrize("text,kind,part", [
    ("mail jane dot doe at example dot com now", "email", "jane dot doe at example dot com"),
    ("jane (at) example (dot) org", "email", "jane (at) example (dot) org"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("＋1 (743) 555‑3824", "phone", "＋1 (743) 555‑3824"),
    ("card 4111 1111 1111 one one one one.", "card", "4111 1111 1111 one one one one"),
    ("192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"),
    ("host one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
])
def test_disguised_personal_data_maps_back_to_source(text, kind, part):
    base, every = pii.scan(text)
    start = text.index(part)
    assert base == [] and every == [(kind, start, start + len(part))]


@pytest.mark.parametrize("text", ["stay at example.com for fun", "vier acht neun", "one, two, three", "dots . and @ signs", "аео", ""])
def test_clean_texts_stay_clean(text):
    assert pii.scan(text) == ([], [])


@pytest.mark.parametrize("unit", ["a.a", " dot ", "a_dot_", "(at)", "1.", "one ", "a@", "+1", "x at ", "token= ", "AKIA", "0f", "\"'", "a1-"])
def test_scans_are_linear_on_long_runs(unit):
    import time
    model = secrets.MarkovModel([np.zeros((secrets._SIZE**2, secrets._SIZE - 1))], [np.zeros((secrets._SIZE**2, secrets._SIZE - 1))])
    began = time.time()
    pii.scan(unit * 20_000 + " (at)")
    secrets.scan(unit * 20_000, model)
    assert time.time() - began < 5


def test_personal_data_and_secrets_of_awkward_rows(spark):
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    for out in (pii.personal_data(documents(spark)), secrets.secrets(documents(spark))):
        rows = out.collect()
        assert len(rows) == len(awkward())
        assert all(r["base_sha256"] == nothing and r["spans"] == "" for r in rows if r["doc_id"] in (0, 1, 2))
    assert pii.personal_data(empty(spark)).count() == 0 and secrets.secrets(empty(spark)).count() == 0


@pytest.mark.parametrize("text,span", [
    ("a" * 70 + " [at] example [dot] com", ("email", 0, 93)), ("x" * 3000 + " at " + "y" * 200 + " dot com", ("email", 0, 3212)), ("192[.]168[.]001[.]0001", ("ip", 0, 22)),
    ("j\u043ehn@example.com", ("email", 0, 16)), ("x_at_x_at_example.com", ("email", 0, 21)), ("write j.o_at_ex-dot-ample.org", ("email", 6, 29)),
])
def test_disguises_of_any_length_and_around_base_spans(text, span):
    base, every = pii.scan(text)
    assert span in every and span not in base and set(base) <= set(every)


@pytest.mark.parametrize("unit", ["x_at_", "a dot ", "a at b ", "john@", "a [dot] ", "_at_-at-%40", "1 . ", "a-dot-", "&#64;a"])
def test_disguises_are_read_in_linear_time(unit):
    start = time.perf_counter()
    pii.scan(unit * 20_000)
    assert time.perf_counter() - start < 3


# --- secrets

def brute_secrets(text: str) -> list:
    out = [("assign", *m.span()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(1)) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return in_order(out, secrets.KINDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Token", "passwd", "api_key", "APIKEY", " = ", ":", "\"", "AKIA", "A1B2C3D4E5F6G7", "0123abcd", "ef" * 5, "xyz_", "K", " ", "="]), max_size=12).map("".join))
def test_base_secrets_against_plain_patterns(text):
    assert secrets.found(text) == brute_secrets(text)


def test_random_keys_are_told_from_identifiers(spark):
    model = secrets.train(table(spark, SMALL, "documents"))
    rng = random.Random(77)
    letters = secrets.ALPHABET[:62]
    keys = ["".join(rng.choices(letters, k=rng.randint(24, 48))) for _ in range(200)]
    caught = sum(bool(secrets.scan(f"use {k} here", model)[1]) for k in keys)
    names = ["getUserAccountDetails2FromCache", "user_profile_settings_v2_final", "/usr/local/lib/python3/site-packages", "https//www/example/com/2023/some-article-title",
             "MAX_RETRY_COUNT_EXCEEDED_404_ERROR", "convert-report-to-monthly-table-2020", "Connection2DatabaseFailedWithTimeout"]
    assert caught >= 195
    assert [n for n in names if secrets.scan(f"use {n} here", model)[1]] == []


@pytest.fixture(scope="module")
def secret_model(spark):
    return secrets.train(table(spark, SMALL, "documents"))


@pytest.mark.parametrize("alphabet,size,least", [(secrets.ALPHABET[:62], 16, 0.97), (secrets.ALPHABET[:62], 18, 0.97), (secrets.ALPHABET[:62], 24, 0.99),
                                                 (secrets.ALPHABET[:52], 24, 0.97), (secrets.ALPHABET[:26], 24, 0.95), (secrets.ALPHABET[:62], 12, 0.9)])
def test_keys_without_digits_and_short_keys_are_told_by_the_models(secret_model, alphabet, size, least):
    rng = random.Random(size)
    keys = ["".join(rng.choices(alphabet, k=size)) for _ in range(300)]
    assert sum(("random", 4, 4 + size) in secrets.scan(f"use {k} here", secret_model)[1] for k in keys) >= least * 300


def test_ordinary_tokens_of_any_length_stay(secret_model):
    plain = ["-" * 30, "=" * 14, "internationalization", "getElementsByClassName", "2024-01-15-0000-0000", "00000000-0000-0000-0000-000000000000", "anticonstitutionnellement",
             "/usr/local/lib/python/site-packages", "1234567890123456"[:14]]
    assert [p for p in plain if secrets.scan(f"use {p} here", secret_model)[1]] == []


def test_ratio_equals_plain_sums_over_characters(secret_model):
    tokens = ["aB3dE5gH7jK9mN1p", "thereonheraldtion", "x/y_z-0=a+b/c", "Q" * 12]
    place = {c: i for i, c in enumerate(secrets.ALPHABET)}
    size = len(secrets.ALPHABET) + 1

    def plain(token, models):
        best = []
        for m in models:
            total, one, two = 0.0, size - 1, size - 1
            for c in token:
                total += m[one * size + two][place[c]]
                one, two = two, place[c]
            best.append(total)
        return max(best)
    want = [plain(t, secret_model.random) - plain(t, secret_model.ordinary) for t in tokens]
    assert np.allclose(secret_model.scores(tokens), want)
    assert secret_model.score(tokens[0]) == pytest.approx(want[0] / 16)



# --- decontamination

def sellers(pattern: str, text: str) -> int:
    """Fewest edits of the whole pattern anywhere in the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(text: str, edits: int, rng: random.Random) -> str:
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        chars[at:at + 1] = rng.choice([[], ["x"], [chars[at], "q"]])
    return "".join(chars)


def test_decontamination_finds_all_within_the_edit_budget():
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(4, 40))) for i in range(30)]
    index = decontaminate.index_of(items)
    text = dict(zip(range(len(index.item)), index.text))
    for trial in range(60):
        i = rng.randrange(len(index.item))
        pattern, e = text[i], int(index.edits[i])
        doc = prose(rng, rng.randint(0, 40)) + " " + edited(pattern, rng.randint(0, e + 2), rng) + " " + prose(rng, rng.randint(0, 40))
        found = {r for r, _, _ in decontaminate.matches(doc, index)}
        within = {r for r in text if sellers(text[r], decontaminate.normalised(doc)) <= index.edits[r]}
        assert found == within, (trial, found, within)


def test_decontamination_scans_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    item = prose(rng, 30)
    index = decontaminate.index_of([(1, item)])
    monkeypatch.setattr(decontaminate, "PIECE", 300)
    for lead in range(0, 120, 7):
        doc = prose(rng, lead) + " " + item.upper().replace(" ", " \n ") + " " + prose(rng, 90)
        assert decontaminate.matches(doc, index)


def test_long_items_are_found_by_region():
    rng = random.Random(6)
    item = prose(rng, 400)
    index = decontaminate.index_of([(1, item)])
    assert len(index.item) > 3
    words = item.split()
    assert decontaminate.matches(prose(rng, 20) + " " + " ".join(words[100:250]), index)
    assert not decontaminate.matches(prose(rng, 400), index)


def test_decontamination_of_awkward_rows_in_blocks(spark):
    rows = awkward()
    bench = spark.createDataFrame([(1, rows[8][1], "x"), (2, rows[8][1], "x"), (3, None, "x"), (4, "", None), (5, "tiny", None), (None, prose(random.Random(1), 30), None)],
                                  "item_id long, text string, doc_id string")
    one = decontaminate.contaminated(documents(spark), bench)
    many = decontaminate.contaminated(documents(spark), bench, block_chars=100)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    hit = {8, 9, 10, 13, 16}
    assert {r["doc_id"] for r in one.collect()} == hit | {None}
    assert {r["item_id"] for r in one.collect()} == {1, 2}
    clean = decontaminate.without_benchmark(documents(spark), bench, block_chars=100)
    assert clean.columns == documents(spark).columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - hit
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark), none).count() == 0
    assert decontaminate.without_benchmark(documents(spark), none).count() == len(rows)
    assert decontaminate.contaminated(empty(spark), bench).count() == 0


def test_short_items_are_found_exactly_at_word_boundaries(spark):
    index = decontaminate.index_of([(1, "What is  two plus"), (2, "42"), (3, " \n"), (4, "what is two plus"), (5, "Is two"), (6, prose(random.Random(1), 30))])
    found = lambda t: {index.item[r] for r, _, _ in decontaminate.matches(t, index)}
    assert found("ask: WHAT is two\nplus three") == {1, 4, 5}
    assert found("what is two pluses") == {5} and found("somewhat is two plus") == {5}
    assert found("a 42") == {2} and found("42") == {2} and found("142 and 42nd") == set() and found("x(42)") == {2}
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = {r["doc_id"] for r in decontaminate.without_benchmark(documents(spark), bench).collect()}
    assert 4 not in kept and 3 in kept


def test_common_q_grams_are_counted_in_slices(monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 25)) for i in range(40)]
    doc = prose(rng, 300) + " " + items[7][1] + " " + prose(rng, 100) + " " + items[9][1][3:]
    index = decontaminate.index_of(items)
    whole = sorted(decontaminate.matches(doc, index))
    monkeypatch.setattr(decontaminate, "ROWS", 50)
    assert sorted(decontaminate.matches(doc, index)) == whole and {index.item[r] for r, _, _ in whole} >= {7, 9}


# --- packing

def test_best_fit_decreasing_takes_the_tightest_fit():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 80))]
        plan = packing.best_fit_decreasing(lengths, 50)
        assert sorted(i for p in plan for i in p) == list(range(len(lengths)))
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):  # brute force: the least room that holds it
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(50 - n)
        assert sorted(50 - sum(lengths[i] for i in p) for p in plan) == sorted(rooms)


@pytest.mark.parametrize("seq_len,shard", [(16, 64), (2048, 4 << 20)])
def test_packing_is_a_round_trip(spark, seq_len, shard):
    rows = [(i, r[1], *[None] * 11) for i, r in enumerate(awkward())]
    out = packing.packed(documents(spark, rows), seq_len=seq_len, shard_tokens=shard).collect()
    encoder = packing.Encoder(open(packing.VOCABULARY, "rb").read())
    back = packing.documents_of(out)
    assert {k: encoder.decode(v) for k, v in back.items()} == {i: t or "" for i, t, *_ in rows}
    assert all(v[-1] == encoder.end for v in back.values())
    for r in out:
        ids, places = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(places) == seq_len and r["cu_seqlens"][-1] == r["n_tokens"] <= seq_len
        assert places[:r["n_tokens"]].tolist() == [k for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]) for k in range(b - a)]
        assert (ids[r["n_tokens"]:] == encoder.end).all()
    assert len({(r["shard"], r["sequence"]) for r in out}) == len(out)


def test_packing_of_null_ids_repeats_and_nothing(spark):
    out = packing.packed(documents(spark)).collect()
    pieces = [d for r in out for d, p in zip(r["doc_ids"], r["pieces"]) if p == 0]
    assert sorted(map(repr, pieces)) == sorted(repr(r[0]) for r in awkward())
    assert packing.packed(empty(spark)).count() == 0


# --- page text

def test_decoding_is_the_best_of_all_assignments():
    """Wrapper, content or cut for every node: no allowed assignment scores higher than the decoded one."""
    rng = random.Random(12)

    def html(left: int) -> tuple[str, int]:
        out, used = "", 0
        while used < left and rng.random() < 0.75:
            inner, n = html(left - used - 1)
            tag = rng.choice(["div", "p", "section", "ul", "nav", "script"])
            out += f"<{tag}>{rng.choice(['', 'some words', 'x'])}{inner}</{tag}>"
            used += n + 1
        return out, used

    tried = 0
    for _ in range(60):
        page = html_text.parsed("<body>" + html(6)[0] + "text</body>")
        n = len(page.tag)
        if n > 9:
            continue
        tried += 1
        p = np.array([rng.random() for _ in range(n)])
        own = np.zeros(n)
        for block, text in page.runs:
            own[block] += len(text)
        weight, clipped = 0.2 + np.log1p(own), np.clip(p, 1e-4, 1 - 1e-4)
        score = lambda kept: sum(w * np.log(q if k else 1 - q) for w, q, k in zip(weight, clipped, kept))
        best = -np.inf
        for states in itertools.product((0, 1, 2), repeat=n):
            fine = all((states[page.parent[i]], s) in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)) for i, s in enumerate(states) if i)
            if fine and all(states[i] == 2 for i in range(1, n) if page.tag[i] in html_text.NEVER):
                best = max(best, score([s == 1 for s in states]))
        assert score(html_text.decoded(page, p)) == pytest.approx(best, abs=1e-9)
    assert tried > 20


def test_trees_are_read_back_exactly(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] * x[:, 3] > 0.2)).astype(float)
    frame = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, f array<double>").select("label", array_to_vector("f").alias("features"))
    model = GBTClassifier(maxIter=6, maxDepth=4, seed=1).fit(frame)
    want = np.array([r["probability"][1] for r in model.transform(frame).select("probability").collect()])
    assert html_text.trees_of(model, 4).probability(x) == pytest.approx(want, abs=1e-9)


def test_main_text_of_pages_and_of_other_layouts(spark):
    pages = table(spark, SMALL, "pages")
    trees = html_text.train(pages)
    good = n = 0
    for r in pages.limit(150).collect():
        page = html_text.parsed(r["html"])
        labels = html_text.semantic_labels(page)
        assert html_text.extracted(r["html"], trees) == html_text.main_text(page, [bool(y) for y in labels])
        texts = [t for b, t in page.runs if labels[b]]
        paragraphs = [t for t in texts if len(t) > 60]
        if paragraphs:  # layouts that training hasn't seen
            made = html_text.parsed(html_text.layout(paragraphs, [t[:40] for t in texts], random.Random(10**7 + r["page_id"])))
            keep = html_text.decoded(made, trees.probability(html_text.features(made)))
            n += 1
            good += keep and html_text.main_text(made, keep) == html_text.main_text(made, [y == "1" for y in made.label])
    assert n > 100 and good / n > 0.9


@pytest.mark.parametrize("source,runs", [
    (None, []), ("", []), ("<p>a<p>b", ["a", "b"]), ("<!-- x", []), ("<script>var t='</p>'</script>x", ["x"]), ("<p>a &amp;&lt; b < c</p>", ["a &< b < c"]),
    ("<a href='x", []), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<p>a <b>b<br>c<p>d</b> e", ["a b c", "d e"]),
    ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", ["a", "b", "c", "d"]), ("</p>x</div>y", ["xy"]), ("<p a=\"1>2\" class='c'>x", ["x"]), ("x  \n y", ["x y"]),
])
def test_parser_on_odd_html(source, runs):
    assert [t for _, t in html_text.parsed(source).runs] == runs


def test_deep_page_and_contradictions():
    page = html_text.parsed("<div>" * 20_000 + "x")
    assert len(html_text.features(page)) == 20_001 and len(html_text.decoded(page, np.full(20_001, 0.4))) == 20_001
    page = html_text.parsed("<body><div>a<p>b<p>c</div><nav>d<p>e</nav></body>")
    for seed in range(50):
        p = np.random.default_rng(seed).random(len(page.tag))
        keep = html_text.decoded(page, p)
        for i in range(1, len(keep)):
            inside = [keep[i]]
            k = i
            while page.parent[k] >= 0:
                k = page.parent[k]
                inside.append(keep[k])
            flips = sum(a != b for a, b in zip(inside, inside[1:]))
            assert flips <= 2


def test_pages_of_nulls_and_nothing(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (None, "u", "<p>x</p>", 3), (2, "u", "", 2)], "page_id long, url string, html string, n_chars long")
    rows = html_text.main_texts(pages).collect()
    assert sorted((repr(r["page_id"]), r["n_chars"]) for r in rows if r["page_id"]) == [("1", 0), ("2", 0), ("2", 0)]
    assert html_text.main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("kind,disguise", [("email", t) for t in (
    "john { at } example.com", "john < at > example.com", "ana[arroba]example.com", "ana<@>example.com", "ana@example . com", "ana (arobase) example.com", "ana%40example.com",
    "ana-klammeraffe-example.com", "ana@example[ dot ]com", "ana@example<period>com", "ana@example&#46;com", "ana[at]example.com")] + [("ip", t) for t in (
        "192 . 168 . 10 . 20", "eight dot eight dot eight dot eight", "8 punkt 8 punkt 8 punkt 8", "8 dot 8 dot 8 dot eight", "\uff18 . 8 . 8 . 8")])
def test_each_disguise_is_found_alone_in_a_text(kind, disguise):
    base, spans = pii.scan(disguise)
    assert not base and [s[0] for s in spans] == [kind]


def test_no_rewrite_is_skipped_that_would_change_a_text():
    rng = random.Random(6)
    pieces = ["at", "arroba", "@", "dot", "punkt", ".", "(", "]", "{", ">", " ", " ", "_", "-", "&#64;", "&period;", "%40", "eight", "SIEBEN", "un", "+", "plus", "12", "7", ",", "ana", "x.com", "\uff18", "\u017f"]
    steps = (pii._look_alikes, pii._spelled_digits, pii._at_and_dot, pii._dots_between_digits)
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(3, 12)))
        whole, needed = pii.Mapped(text), pii.Mapped(text)
        for step in steps:
            whole = whole.rewritten(step(whole))
        for step in pii.steps_for(text):
            needed = needed.rewritten(step(needed))
        assert whole.text == needed.text, text
