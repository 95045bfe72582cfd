"""Hand-made cases of the text, date, reply and wikitext functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers, dates, text, wikitext


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(("f", "given", "wanted"), [
    (text.infobox_key, "chức vụ 2", "office2"), (text.infobox_key, "Foo-Bar baz", "foo_bar_baz"), (text.infobox_key, "birth_year", "birth_date"),
    (text.strip_markup, "[[X|Y]]<br>[[Z]]", "Y, Z"), (text.strip_markup, "{{a}} b<ref>c</ref> [[File:x.png|thumb]]", "b"), (text.strip_markup, None, ""),
    (text.strip_place_markup, "a<br>b [[c|d]]", "ab d"), (text.strip_value_markup, "''A''  [[B]]", "A B"), (text.link_label, "x [[A|B]] [[C]]", "B"), (text.link_label, "x", "x"),
    (text.name_key, "  Nguyễn  VĂN  A ", "nguyễn văn a"), (text.name_key_loose, " A  B ", "a  b"),
    (text.province, "xã A, Hải Hưng", "Hải Dương"), (text.province, "Hà Đông", "Hà Nội"), (text.province, "Paris", ""),
    (text.split_list, "A1 x, A1  x; 12; bc", ["A1 x"]), (text.split_list, "", []), (text.split_awards, "Huân chương X hạng I, II", ["Huân chương X hạng I", "Huân chương X hạng II"]), (text.split_awards, "Medal Z (3)", ["Medal Z"]), (text.split_awards, None, []),
    (text.split_parties, "ĐCSVN; Không", ["Đảng Cộng sản Việt Nam", "Không đảng phái"]), (text.party, "x bị khai trừ", "Đã bị khai trừ khỏi Đảng"),
    (text.office_status, "cách chức, miễn nhiệm", "bị cách chức"), (text.office_status, "miễn nhiệm", "miễn nhiệm"), (text.link_targets, "[[A|b]] [[A]] [[File:x]] [[Vacant]]", ["A"]), (text.plain_names, "A; B, C", ["A; B", "C"]), (text.plain_names, "", []),
    (text.page_name, "/wiki/Nguy%E1%BB%85n_A+B", "Nguyễn A+B"), (text.page_name, "/w/index.php?title=A_B&x=1", "A B"), (text.page_name, "#cite_1", None), (text.page_name, "123", None),
    (text.clean_summary, "a {{b {{c}} d}} [[e|f]] ''g''\n\nh", "a f g. h"), (text.path_signature, None, None), (text.is_local, "Hà Nội, Pháp", True), (text.is_local, "Paris", False), (text.is_person_template, "infobox company", False),
    (dates.normalized, "ngày 5 tháng 3 năm 1971", "1971-03-05"), (dates.normalized, "tháng 3, 1971", "1971-03"), (dates.normalized, "5/3/1971", "1971-03-05"), (dates.normalized, "1971", "1971"), (dates.normalized, "nay", "nay"),
    (dates.birth_year, "sinh 1950, 1990", 1950), (dates.is_date_key, "term_start2", True), (dates.is_date_key, "office", False),
    (answers.choice, "C. Lê", "C"), (answers.choice, "đáp án: b", "B"), (answers.choice, "", None), (answers.truth, "Sai\nvì", "Sai"), (answers.truth, "kết luận: không có dữ kiện", "Không có dữ kiện"), (answers.truth, None, None),
    (answers.verdict, "ĐÚNG", "Đúng"), (answers.options, "Q A. x y B) z", ["A. x y", "B. z"]), (answers.variant_label, "PARAPHRASE_HARD", "Paraphrase"),
])
def test_values(spark, f, given, wanted):
    column = F.lit(given).cast("array<string>" if f is text.path_signature else "string")
    assert one(spark, f(column)) == wanted


def test_date_templates(spark):
    parse = lambda t: one(spark, dates.valid(dates.from_template(F.lit(t), 2025)))
    assert parse("{{ngày sinh và tuổi|1971|8|2}}") == "1971-08-02"
    assert parse("{{death date and age|df=yes|1971|8|2|1900|1|1}}") == "1971-08-02"
    assert parse("2/8/1971") == "1971-08-02"
    assert parse("1850") is None and parse("năm 1950") == "1950-01-01" and parse("30/2/1971") is None


def test_awards_of_years(spark):
    y = one(spark, text.service_years(F.lit("1960 – nay")))
    assert (y.year_start, y.year_end) == (1960, None)


def test_summary(spark):
    page = "x\n'''Nguyễn A''' (1950) là [[B|b]].\n== C ==\nd"
    assert one(spark, text.summary_of(F.lit(page), F.lit("Nguyễn A (chính khách)"))) == "Nguyễn A (1950) là b."
    assert one(spark, text.summary_of(F.lit("none"), F.lit("A"))) is None


def test_paths(spark):
    p = text.path_array(F.lit("pol1 -> SUCCEEDED_INV -> pol2 -> SERVED_AS -> pos3"))
    assert one(spark, text.path_signature(p)) == "Politician->SUCCEEDED_INV->Politician->SERVED_AS->Position"
    assert one(spark, text.path_relations(p)) == ["SUCCEEDED", "SERVED_AS"]


def test_json_of_replies(spark):
    for reply in ('```json\n{"k": 1}\n```', '{"k": 1,}', 'So {"k": 1, "s": "}"} there'):
        assert one(spark, answers.parsed(F.lit(reply), "k int"))["k"] == 1
    assert answers.first_object("a {b {c} d} e") == "{b {c} d}" and answers.first_object("{") is None


def test_infobox():
    name, box = wikitext.infobox_of("a {{cite|x=1}} {{infobox officeholder|name=[[A|B]]|office={{small|x|y}}\n|z}} b")
    assert name == "infobox officeholder" and box == {"name": "[[A|B]]", "office": "{{small|x|y}}", "1": "z"}
    assert wikitext.infobox_of("{{succession infobox|a=1}}") == ("NOT_FOUND", {}) and wikitext.infobox_of(None) == ("NOT_FOUND", {})


def test_list_links(spark):
    html = '<table class="wikitable"><tr><td>1</td><td><a href="/wiki/A">A</a></td></tr><tr><td>2</td><td><a href="/wiki/B">B</a><a href="/wiki/C">C</a></td></tr></table><ol><li><a href="/wiki/D">D</a><a href="/wiki/E">E</a></li></ol>'
    assert one(spark, wikitext.list_links(F.lit(html))) == ["/wiki/A", "/wiki/D"]


def test_similar_names(spark):
    f = lambda a, b: one(spark, answers.name_matches(F.lit(a), F.lit(b)))
    assert f("Nguyễn Văn A", "nguyễn văn a ") and f("Văn", "Nguyễn Văn A") and f("Nguyen Van Anh", "Nguyen Van Ann") and not f("x", "y")
