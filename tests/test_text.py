import re

import numpy as np
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions.citations import extract_citations, parse_citation
from lexweave.functions.segments import (
    chunk_count, chunk_document, detect_sections, match_starts, merge_paragraphs, split_paragraphs, split_sentences,
)


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first().r


def test_strip_html_turns_blocks_into_lines(spark):
    html = "<P>One<br/>two</P><script>x</script><li class='a'>three</LI>"
    assert one(spark, html, tx.strip_html) == "One\ntwo\nxthree\n"


def test_entities_named_numeric_and_untouched(spark):
    assert one(spark, "a &amp; b &#167; &sect; &hellip; &nosuch;", tx.unescape_entities) == "a & b § § … &nosuch;"
    assert one(spark, "plain", tx.unescape_entities) == "plain"
    assert one(spark, None, tx.unescape_entities) is None


def test_unicode_folding_and_zero_width(spark):
    assert one(spark, "ﬁle²​﻿ Ａ", tx.normalize_unicode) == "file2 A"


def test_whitespace_limits_and_trims_all_kinds(spark):
    assert one(spark, "  a \t b\n\n\n\n c \n", tx.normalize_whitespace) == "a b\n\n c"


def test_clean_text_runs_the_steps_in_order(spark):
    html = "<div>x&nbsp;&nbsp;y</div><p>&lt;b&gt;</p>"
    assert one(spark, html, tx.clean_text) == "x y\n<b>"
    df = spark.createDataFrame([(html,), ("a",), (None,)], "h string")
    assert [r.t for r in tx.with_clean_text(df, "h", "t").collect()] == ["x y\n<b>", "a", None]


def cite(spark, text):
    c = one(spark, text, parse_citation)
    return c and (c.volume, c.reporter, c.page, c.pinpoint, c.year, c.raw_text)


def test_citation_forms(spark):
    assert cite(spark, "See 554 U.S. 570, 573 (2008).") == (554, "U.S.", 570, 573, 2008, "554 U.S. 570, 573 (2008)")
    assert cite(spark, "123 F. Supp.  2d 45") == (123, "F. Supp. 2d", 45, None, None, "123 F. Supp.  2d 45")
    assert cite(spark, "12 F.3d 34 (9th Cir. 2015)")[4] is None
    assert cite(spark, "7 F. App'x 8")[1] == "F. App'x"
    assert cite(spark, "1 Cal. Rptr. 3d 2")[1] == "Cal. Rptr. 3d"
    assert cite(spark, "999 Fake 111") is None
    assert cite(spark, "") is None


def test_no_left_boundary_on_volume(spark):
    assert cite(spark, "12345 U.S. 5")[0] == 2345


def test_first_occurrence_per_key_in_text_order(spark):
    text = "2 U.S. 3 and 1 F.3d 9; 2 U.S. 3 (1990); 0554 U.S. 570; 554 U.S. 570"
    found = [c.raw_text for c in one(spark, text, extract_citations)]
    assert found == ["2 U.S. 3", "1 F.3d 9", "0554 U.S. 570"]


def test_following_citation_is_taken_as_pinpoint(spark):
    assert [c.raw_text for c in one(spark, "100 U.S. 200 101 U.S. 201", extract_citations)] == ["100 U.S. 200 101"]


def test_match_starts_equal_finditer(spark):
    text = "ORDER\nx\n\nII. Analysis \n\n\nORDER\norder  \né order\nOrder"
    for pattern in (r"(?mdiu)^order[\s]*$", r"(?mdiu)^(?:I+\.?\s+)?analysis\s*$", r"o", r"zzz"):
        flags = re.M | re.I if "(?mdiu)" in pattern else 0
        want = [m.start() for m in re.finditer(pattern.replace("(?mdiu)", ""), text, flags)]
        assert one(spark, text, lambda t: match_starts(t, pattern)) == want


def sections(spark, text):
    return [(s.label, s.start, s.end) for s in one(spark, text, detect_sections)]


def test_sections_cover_the_text(spark):
    text = "Intro\nSYLLABUS\nab\nFACTUAL BACKGROUND\ncd\nIII. Legal Analysis\nef\nSMITH, J., dissenting:\ngh\nCONCLUSION"
    got = sections(spark, text)
    assert [s[0] for s in got] == ["majority", "syllabus", "background", "analysis", "dissent", "conclusion"]
    assert got[0][1] == 0 and got[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(got, got[1:]))


def test_sections_without_heading_and_at_start(spark):
    assert sections(spark, "no heading here") == [("majority", 0, 15)]
    assert sections(spark, "ORDER\nx")[0] == ("holding", 0, 7)
    assert sections(spark, "syllabus\nx") == [("majority", 0, 10)]


def test_sentences_keep_citations_whole(spark):
    text = 'Held. See 128 S. Ct. 2783. The rule of A. B. stands! "Quoted." (Aside.) end. no split'
    assert one(spark, text, split_sentences) == [
        "Held.", "See 128 S. Ct. 2783. The rule of A.", "B. stands!", '"Quoted." (Aside.) end. no split']


def test_sentence_end_after_accented_letter(spark):
    assert one(spark, "Fin de la journé. Encore", split_sentences) == ["Fin de la journé.", "Encore"]


def test_paragraphs_and_greedy_merge(spark):
    assert one(spark, "a\n \nb\n\n\n\n  c ", split_paragraphs) == ["a", "b", "c"]
    parts = "aaaa\n\nbbbb\n\ncccc"
    assert one(spark, parts, lambda t: merge_paragraphs(split_paragraphs(t), 9)) == ["aaaa\n\nbbbb", "cccc"]
    assert one(spark, parts, lambda t: merge_paragraphs(split_paragraphs(t), 8)) == ["aaaa", "bbbb", "cccc"]
    assert one(spark, "", lambda t: merge_paragraphs(split_paragraphs(t), 8)) == []


def test_chunks_lie_in_the_text_and_respect_the_limit(spark):
    sentence = "The court finds that the record supports it. "
    text = "Intro.\n\nANALYSIS\n\n" + sentence * 200 + "\n\nSee 1 U.S. 2.\n\nCONCLUSION\n\nAffirmed."
    chunks = one(spark, text, chunk_document)
    assert [c.section_type for c in chunks][0] == "majority"
    assert max(len(c.text) for c in chunks) <= 3000
    assert sum(c.text.count("supports it.") for c in chunks) == 200
    for c in chunks:
        assert text.startswith(c.text[:20], c.start_char) and c.end_char == c.start_char + len(c.text)
    assert [c.citation_strings for c in chunks if c.citation_strings] == [["1 U.S. 2"]]


def test_blank_text_has_no_chunks(spark):
    for text in ("", " \n \t", None):
        assert not one(spark, text, chunk_document)


def test_chunking_loses_no_words(spark):
    text = "\n\n".join(f"Paragraph {i} " + "word " * (i % 40) for i in range(300))
    chunks = one(spark, text, lambda t: chunk_document(t, 200, 300))
    assert " ".join(c.text for c in chunks).split() == text.split()


def test_true_offsets_of_repeated_passages(spark):
    para = "The same passage stands here twice, word for word, and is longer than eighty characters in all. " * 25
    text = "  \n\n" + para.strip() + "\n\n \n" + para.strip() + "\n\nII. ANALYSIS\n\n" + para * 2 + "  Tail. "
    for target, limit in ((2000, 3000), (300, 500), (5000, 900)):
        true = one(spark, text, lambda t: chunk_document(t, target, limit))
        first = one(spark, text, lambda t: chunk_document(t, target, limit, parity=True))
        assert [c.text for c in true] == [c.text for c in first]
        at = 0
        for c in true:
            assert c.start_char >= at and text[at:c.start_char].strip() == ""
            assert text[c.start_char:c.end_char].split() == c.text.split()
            assert not text[c.start_char].isspace() and not text[c.end_char - 1].isspace()
            at = c.end_char
        assert text[at:].strip() == ""
    chunks = one(spark, text, chunk_document)
    again = [c.start_char for c in chunks if c.text == para.strip()]
    assert len(again) == 2 and len(set(again)) == 2


def test_chunks_are_counted_by_lengths(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \n ", "x" * 9000, "I. ORDER\n\n" + "a b. C d. " * 900]
    for _ in range(40):
        parts = ["Word word 1 U.S. 2 (1999). " * int(rng.integers(1, 200)) for _ in range(int(rng.integers(1, 9)))]
        texts.append(str(rng.choice(["\n\n", "\n", " \n \n", "\n\nHOLDING\n\n"])).join(parts))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for target, limit in ((2000, 3000), (300, 301), (100, 100), (900, 400)):
        got = df.select(chunk_count(F.col("t"), target, limit).alias("n"), F.coalesce(
            F.size(chunk_document(F.col("t"), target, limit)), F.lit(0)).alias("m")).collect()
        assert [r.n for r in got] == [r.m if r.m > 0 else 0 for r in got]
