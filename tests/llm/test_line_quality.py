"""Rules of single lines, and lines of any length."""

import duckdb

from topicloom.llm.line_quality import line_fails, line_quality
from topicloom.llm.queries import LINE_FAILS_SQL


def test_scripts_without_case_do_not_shout(spark):
    clean = ["한국방송공사 KBS 뉴스는 오늘 저녁 아홉 시에 시작합니다", "تعمل منظمة UNESCO في مجال التربية والعلوم والثقافة", "人工智能 AI 技术正在改变我们每个人的日常生活和工作方式，影响深远"]
    loud = ["BUY NOW WHILE STOCKS LAST", "ÉCOUTEZ BIEN, 1 000 PRIX À GAGNER", "КУПИТЕ ПРЯМО СЕЙЧАС И ЗДЕСЬ"]
    lines = spark.createDataFrame([(x,) for x in clean + loud], "line string")
    got = {r[0]: r[1] for r in lines.select("line", line_fails(lines.line)).collect()}
    assert [got[x] for x in clean] == [False] * 3 and [got[x] for x in loud] == [True] * 3


LINES = [
    ("Home | About us | Contact | Login", True),
    ("Startseite | Kontakt | Impressum", True),
    ("Accueil > Recherche > Mentions légales", True),
    ("Inicio · Buscar · Iniciar sesión", True),
    ("help search", True),
    ("We searched for help at home.", False),
    ("homesearch", False),
    ("Kurz notiert", False),
    ("Tous droits RÉSERVÉS 2020.", True),
    ("Alle Rechte vorbehalten.", True),
    ("word " * 30, True),
    ("word " * 30 + "end.", False),
    ("คำ " * 40, False),
    ("字 " * 30 + "。", False),
    ("!!! Buy now !!!", True),
    ("# % & * < > |", True),
    ("- - -", False),
    ("", False),
]


def test_lines_and_the_same_in_sql(spark):
    frame = spark.createDataFrame([(x,) for x, _ in LINES], "line string")
    got = {r[0]: r[1] for r in frame.select("line", line_fails(frame.line)).collect()}
    assert got == dict(LINES)
    sql = {x: duckdb.execute(f"SELECT {LINE_FAILS_SQL} FROM (SELECT ? AS x)", [x]).fetchone()[0] for x, _ in LINES}
    assert sql == got


def test_lines_of_any_length_and_columns_of_any_name(spark):
    long = ["home " * 100_000, "home|" * 100_000 + "home", "| " * 100_000, "A" * 100_000, "AB " * 100_000, "word" * 100_000, "all rights reserved " * 10_000]
    good = "This is a sentence that a reader understands well. " * 20
    rows = [(i, x + "\n" + good, "w", "l", "p", "r") for i, x in enumerate(long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _words string, _lines string, `_passing` string, row string")
    out = line_quality(frame)
    assert out.columns == [*frame.columns, "quality"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].quality.clean_text == good for i in range(len(long))] == [True, True, True, True, True, False, True]
    assert got[0]._words == "w" and got[0].row == "r"
