"""The forest on planted files, copies and data; notices are not features."""

import random

from lodestitch.llm import handwritten as H

NAMES = "invoice ledger order basket tenant profile window cursor shard digest review policy token market vendor".split()


def person(rnd):
    out = ["import { tool } from './tool';", ""]
    for _ in range(rnd.randrange(3, 8)):
        a, b, c = rnd.sample(NAMES, 3)
        out += [f"// {rnd.choice(['keep', 'see', 'drop'])} the {a} before {b} {rnd.randrange(99)}", f"export function {rnd.choice(['load', 'make', 'send'])}{a.title()}({b}, options) {{"]
        for _ in range(rnd.randrange(2, 7)):
            x, y = rnd.sample(NAMES, 2)
            out.append(rnd.choice([f"  const {x} = {y}.map((item) => item.{c} + {rnd.randrange(99)});", f"  if (!{x}.{y}) return null;", f"  log.debug('no {x} for {y}', options, {rnd.randrange(999)});", f"  while ({x}.next()) {y}({c});"]))
        out += [f"  return {b};", "}", ""]
    return "\n".join(out)


def machine(rnd):
    a, k = rnd.choice(NAMES), rnd.randrange(500)
    return "\n".join(f"export const {a}Get{n:04d} = (id) => transport.call('{a}', {n}, [id]);" for n in range(k, k + rnd.randrange(12, 40)))


def test_planted(spark):
    rnd = random.Random(9)
    files, texts, want = [], [], set()

    def add(text, origin="repository", found=False):
        n = len(files)
        files.append((n, f"src/f{n}.js", origin, "x"))
        texts.append((n, text))
        if found:
            want.add(n)

    for _ in range(150):
        add(person(rnd))
    for k in range(60):
        text = machine(rnd)
        add(text if k % 3 else f"// @generated by tool. DO NOT EDIT.\n{text}", found=True)
    originals = [person(rnd) for _ in range(10)]
    for t in originals:
        add("/*! lib v1 */\n" + t, " Dependency ")
    add(originals[0], found=True)
    add("// copied\n" + originals[1].replace("  ", "\t").replace("no ", "NO "), found=True)
    add(originals[1], found=True)
    add("export default [" + ",".join(str(rnd.randrange(999)) for _ in range(500)) + "]", found=True)
    add("")
    add(None, None)
    add("// Writes files that start with '@generated'; edited by hand.\n" + person(rnd))
    f = spark.createDataFrame(files, "id long, path string, origin string, digest string")
    s = spark.createDataFrame(texts, "file_id long, content string")
    got = {r.file_id for r in H.machine_written(spark, f, s).filter("found").collect()}
    assert len(got ^ want) <= 2 and {n for n in want if n >= 220} <= got


def test_without_labels(spark):
    f = spark.createDataFrame([(1, "a.js", "repository"), (2, "b.js", None)], "id long, path string, origin string")
    s = spark.createDataFrame([(1, "a()"), (2, None)], "file_id long, content string")
    assert H.machine_written(spark, f, s).filter("found").count() == 0
    assert H.machine_written(spark, f.limit(0), s).count() == 0


def test_notices_and_data():
    assert H.notice("/* x */ // Code generated by t. DO NOT EDIT.\nlet a") == "generated"
    assert H.notice("<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n// @generated\n") == "generated"
    assert H.notice("let a; // @generated") is None
    assert H.notice("// Writes '@generated' files; kept by the team\n") is None
    assert H.notice("/*! lib v1 | MIT */") == "banner"
    big = ",".join(str(k) for k in range(400))
    assert H.is_data(f"[{big}]") and H.is_data(f"module.exports = [{big}];") and not H.is_data("[1, 2]")
    assert not H.is_data('{"a": [' + big + "]}") and not H.is_data(f"[{big}].map(f); " + "const names = load(other, thing);" * 9)
    assert H.features("// @generated\nlet a = 1") == H.features("let a = 1")


def test_every_contained_copy_is_found(spark):
    rnd = random.Random(4)
    originals = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) for _ in range(40)]
    files = [(k, f"lib/{k}.js", "dependency") for k in range(40)]
    texts = list(enumerate(originals))
    want = set()
    for k, t in enumerate(originals):  # cut to between 10 and 60 hundredths, a few words altered
        words = t.split()[: 40 + 5 * k]
        if k % 2:
            words[len(words) // 2] = "altered"
        files.append((100 + k, f"src/{k}.js", "repository"))
        texts.append((100 + k, " ".join(words)))
        want.add(100 + k)
    for k in range(5):  # a whole copy with text of half its length added; and a small part of something else
        files += [(200 + k, f"src/more{k}.js", "repository"), (300 + k, f"src/other{k}.js", "repository")]
        more = " ".join(f"x{rnd.randrange(10**6)}" for _ in range(200))
        texts += [(200 + k, originals[k] + " " + more), (300 + k, " ".join(originals[k].split()[:40]) + " " + more)]
        want.add(200 + k)
    f = spark.createDataFrame(files, "id long, path string, origin string")
    s = spark.createDataFrame(texts, "file_id long, content string")
    got = {r.file_id for r in H.machine_written(spark, f, s).filter("is_copy").collect()}
    assert got == want


def words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_common_text_makes_no_candidates(spark, monkeypatch):
    rnd = random.Random(6)
    blocks = [words(rnd, 45) for _ in range(3)]
    files, texts = [], []

    def add(n, origin, parts):
        files.append((n, f"src/{n}.js", origin))
        texts.append((n, " ".join(parts)))

    for k in range(60):
        add(k, "dependency", blocks[k % 3] + words(rnd, 60))
        add(100 + k, "repository", sum(rnd.sample(blocks, 3), []) + words(rnd, 75))
    want = {200 + k for k in range(6)}
    for k in range(6):
        add(200 + k, "repository", texts[2 * k][1].split() + words(rnd, 20))
    kept, keep = [], H.Scratch.keep

    def spy(self, df):
        kept.append(keep(self, df))
        return kept[-1]

    monkeypatch.setattr(H.Scratch, "keep", spy)
    f = spark.createDataFrame(files, "id long, path string, origin string")
    s = spark.createDataFrame(texts, "file_id long, content string")
    assert {r.file_id for r in H.machine_written(spark, f, s).filter("is_copy").collect()} == want
    (pairs,) = [df for df in kept if df.columns == ["rep", "third_rep"]]
    assert pairs.count() <= 2 * len(want)


def test_full_tables_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(H, "PLACES_MOST", 6)
    monkeypatch.setattr(H, "MARKS_MOST", 9)
    monkeypatch.setattr(H, "SLICE", 16)
    test_every_contained_copy_is_found(spark)


def test_marks_and_counts(spark):
    rnd = random.Random(2)
    found = list(H.shingle_sets([" ".join(words(rnd, 80)) for _ in range(30)] + [""]))
    rows = [(k, len(h), h.view("int64").tolist()) for k, h in enumerate(found)]
    packed = H.frequencies(spark.createDataFrame(rows + rows[:10], "rep long, n long, shingles array<long>"))
    counts, marks = H.unpacked(packed)
    assert all(H.probes(h, counts, marks)[0] == len(h) for h in found)
    other = next(H.shingle_sets([" ".join(words(rnd, 80))]))
    assert H.probes(other, counts, marks)[0] < 20 and not len(H.probes(other, counts, marks)[1])
    assert H.frequencies(spark.createDataFrame([], "rep long, n long, shingles array<long>"))[1] == {}
