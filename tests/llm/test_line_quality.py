"""Quality rules against line by line counting."""

import re
from collections import Counter, defaultdict

from fairlake.llm import line_quality


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow(rows, share=0.05, least=10, depleted=0.7):
    docs, hosts = defaultdict(set), defaultdict(set)
    for doc, text, host in rows:
        hosts[host].add(text)
        for line in (text or "").split("\n"):
            if w := split(line.lower()):
                docs[host, " ".join(w)].add(text)
    often = {k for k, texts in docs.items() if len(texts) > least and len(texts) > share * len(hosts[k[0]])}
    out = []
    for doc, text, host in rows:
        w = split(text)
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        gone = sum(len(split(x)) for x in lines if (host, " ".join(split(x.lower()))) in often)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
                    len(covered), gone, failed, not failed and gone <= depleted * len(w)))
    return sorted(out, key=str)


def fast(df, **options):
    return sorted((tuple(r) for r in line_quality.line_quality(df, **options).collect()), key=str)


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", True) for i, t, s in rows],
                                 "doc_id long, text string, source string, line int, host string, kept boolean").repartition(4)


def test_boilerplate_repeats_and_edge_cases(spark):
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    menu = "Home  About us\tContact and all the other pages of this site for you"
    rows = [(i, f"{menu.upper() if i % 2 else menu}\n{body(i, 10 if i % 5 else 2)}\n\n end of {i}", "a") for i in range(40)]
    rows += [(i, f"{menu}\n{body(i, 25)}", "b" if i < 58 else None) for i in range(50, 75)]
    rows += [(100 + i, body(7, 30), "copies") for i in range(30)]
    rows += [(200, None, "a"), (201, "", "a"), (202, " \n\t", None), (203, "# * <b> && " + body(1, 22) + " é́ \U0001f600", "c"),
             (204, "one two three four five six seven eight " * 9, "c"), (205, "same " * 60, "c"), (206, body(3, 8) + " " + body(4, 60) + " " + body(3, 8), "c"),
             (207, "L1 a\nL1 a\nl1 a\nL1  a\n" + body(5, 20), "c"), (208, body(9, 40_000), "c"), (209, "q" * 100_000, "c")]
    df = make(spark, rows)
    got = fast(df)
    assert got == slow(rows)
    kept = {r[0]: r[-1] for r in got}
    assert not kept[0] and kept[1] is False or kept[1] and all(kept[i] for i in range(100, 130)) and kept[208]
    assert fast(df, share=0.3, least=3, depleted=0.2) == slow(rows, 0.3, 3, 0.2)


def test_empty_and_repeated_rows(spark):
    assert fast(make(spark, [])) == []
    rows = [(5, "menu line of six words here\n" + " ".join(f"t{k}" for k in range(20)), "h")] * 3 + [(None, "menu line of six words here", None)] * 2
    rows += [(i, f"menu line of six words here\n{i}", "h") for i in range(20, 40)]
    assert fast(make(spark, rows)) == slow(rows)


def test_frequent_lines_leave_the_text(spark):
    menu = "Home  About us"
    rows = [(i, f"{menu.upper() if i % 2 else menu}\n\nbody {i}\n{menu}\n end of {i}", "a" if i < 30 else None) for i in range(60)]
    rows += [(70, f"{menu}\nelsewhere", "b"), (71, None, "a"), (72, "", "a"), (73, menu, "a"), (73, menu, "a"), (74, " \n", None)]
    df = make(spark, rows)
    got = line_quality.remove_frequent_lines(df)
    want = [(i, f"\nbody {i}\n end of {i}") for i in range(60)]
    want += [(70, f"{menu}\nelsewhere"), (71, None), (72, ""), (73, ""), (73, ""), (74, " \n")]
    assert got.columns == [*df.columns, "kept_text"]
    assert sorted(((r.doc_id, r.kept_text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_no_python_on_the_main_path(spark):
    plan = line_quality.line_quality(spark.sql("SELECT 1L AS doc_id, 'x' AS text, 'y' AS source"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
