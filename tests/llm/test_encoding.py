import random

import pytest

from tidelog.llm import encoding

TEXTS = ["Größe prüfen für alle Läufe", "la señal de cierre ¿por qué fallaba?", "l’écriture côté réplique a échoué", "Проверка очереди после сбоя узла", "Το κενό κλειδί μετά την αποτυχία", "przyśpiesz wątek żeby uniknąć powtórzeń", "při každém spuštění se zamkne", "geçersiz bağlantıyı yeniden başlatınca", "設定ファイルの検査を追加した", "重启之后会失败，避免重复发送", "costs €3 – “fast” path… ½ of the rows", "┌──────┬──┐ │ä ö│"]
FINE = ["", "plain", "caf&eacute;", 'bad = "\\ufffd"', 'title := "SÃO ÂNGELO ÇÂÃ"', 'units = "µm, Å, Ø, ±"', 'flags = "Ð Þ ð þ"', "abc αβγδ абвгд", "→ ⇒ ≤ ≥ ≠", "ВНИМАНИЕ: СССР", "naïve résumé – done…", "Zoë Ångström Łukasz Žďár", "a &amp; b", "10 °C ± 5 %", "«да» и “нет”"]


def garble(text, right, wrong):
    out = []
    for b in text.encode(right):
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "mac_roman", "cp437", "cp850"])
def test_utf8_read_as_something_else_is_restored(text, wrong):
    bad = garble(text, "utf-8", wrong)
    new, path = encoding.restore_line(bad)
    assert path and new == text


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
def test_garbled_twice(wrong):
    for text in TEXTS[:10]:
        new, path = encoding.restore_line(garble(garble(text, "utf-8", wrong), "utf-8", "latin-1"))
        assert new == text and len(path) == 2


@pytest.mark.parametrize("text,right,wrong", [(TEXTS[3], "cp1251", "latin-1"), (TEXTS[3], "koi8-r", "cp1251"), (TEXTS[4], "cp1253", "latin-1"), (TEXTS[5], "iso8859-2", "latin-1"), (TEXTS[9][:6], "gb2312", "latin-1"), (TEXTS[8], "cp932", "cp1252"), (TEXTS[8], "euc_jp", "latin-1"), (TEXTS[1], "cp1252", "mac_roman"), (TEXTS[0], "cp437", "cp1252")])
def test_other_encodings(text, right, wrong):
    assert encoding.restore_line(garble(text, right, wrong))[0] == text


def test_utf8_read_as_a_wide_encoding():
    for text in ("页面文字减少内存占用补充测试", "连接超时日志格式补充测试"):
        bad = text.encode("utf-8").decode("gb18030")
        assert encoding.restore_line(bad)[0] == text


@pytest.mark.parametrize("text", FINE + TEXTS)
def test_good_text_stays(text):
    assert encoding.restore_text(text) == (text, 0, 0)


def test_a_passage_in_a_good_text():
    bad = garble("für", "utf-8", "cp1252")
    text = f"Größe\r\n\t# {bad} alle\n+ good line – “ok”\r{chr(0xFFFD)} lost"
    assert encoding.restore_text(text) == (text.replace(bad, "für"), 1, 1)
    # entities are undone on the way, but aren't a fault themselves
    assert encoding.restore_line("gr&Atilde;&frac14;n")[0] == "grün"


def test_documents(spark):
    r = random.Random(1)
    rows = [(1, None), (2, ""), (3, "ascii only " * 10_000), (4, garble(TEXTS[0], "utf-8", "latin-1")), (5, TEXTS[0]), (None, garble(TEXTS[1], "utf-8", "cp1252")), (6, "ok\n" * 5000 + garble(TEXTS[2], "utf-8", "cp437") + "\n" + "x" * 100_000), (7, "".join(chr(r.randint(0x80, 0x2FFF)) for _ in range(2000))), (4, garble(TEXTS[0], "utf-8", "latin-1"))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, restored string")
    got = [(x["doc_id"], x["restored"]) for x in encoding.garbled(df).collect() if x["doc_id"] != 7]
    assert sorted(got, key=str) == sorted([(4, TEXTS[0]), (4, TEXTS[0]), (None, TEXTS[1]), (6, "ok\n" * 5000 + TEXTS[2] + "\n" + "x" * 100_000)], key=str)
    assert encoding.garbled(df.limit(0)).count() == 0


def test_spaces_that_were_part_of_a_character():
    assert encoding.restore_line("å\x8d ç\x94¨ – ok")[0] == "占用 – ok"
    assert encoding.restore_line("grÃ¢ce Ã  un")[0] == "grâce à un"
    assert encoding.restore_line("à la Ã  b")[1] == ()


def test_a_text_is_garbled_in_one_way():
    lines = ["Pøidej ètení øádkù ne¾ zaène pøenos", "b³±d po³±czenia ¿eby unikn±æ", "ètení øádkù"]
    whole = encoding.restore_text("\n".join(lines))
    # the last line has nothing odd in it and stays
    assert whole == ("Přidej čtení řádků než začne přenos\nbłąd połączenia żeby uniknąć\nètení øádkù", 2, 0)


def test_wrong_letters_that_are_letters_of_another_language(spark):
    czech = ["čtení řádků když není žádný výstup", "při čtení řádků není žádný výstup"]
    turkish = ["bağlantıyı yeniden başlatınca", "boş anahtarı yeniden doğrula"]
    french = ["après l’écriture côté réplique ça échoue", "où la mémoire était déjà pleine"]
    good = [x for x in (*czech, *turkish, *french, "São Ângelo", "við það", *FINE) for _ in range(3)]
    bad = [(garble(czech[0], "cp1250", "cp1252"), czech[0]), (garble(turkish[0], "cp1254", "latin-1"), turkish[0])]
    rows = [*enumerate(good), *((1000 + i, "a good line\n- // " + b) for i, (b, _) in enumerate(bad))]
    got = encoding.garbled(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["restored"], r["lines_restored"]) for r in got) == [(1000 + i, "a good line\n- // " + x, 1) for i, (_, x) in enumerate(bad)]


def test_the_better_operation_of_a_line_is_kept():
    czech = "zpožděný záznam než začne přenos"
    known = encoding.Company(dict.fromkeys(encoding.company_of(czech), 50))
    lines = [*(garble(f"{x} přenos čtení", "iso8859-2", "latin-1") for x in ("řádků", "dlouhý řetězec", "příliš")), garble(czech, "cp1250", "cp1252")]
    assert encoding.restore_text("\n".join(lines), known)[0].split("\n")[-1] == czech


HEBREW, ARABIC, THAI = "בדיקת התור אחרי כשל השרת", "فحص الطابور بعد فشل الخادم", "ตรวจสอบคิวหลังจากเซิร์ฟเวอร์ล้มเหลว"


@pytest.mark.parametrize("text,right", [(HEBREW, "cp1255"), (ARABIC, "cp1256"), (THAI, "cp874"), (TEXTS[3], "cp1251"), (TEXTS[4], "cp1253")])
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
def test_scripts_are_not_taken_for_each_other(text, right, wrong):
    assert encoding.restore_line(garble(text, right, wrong))[0] == text
    assert encoding.restore_text(text) == (text, 0, 0)


@pytest.mark.parametrize("layers", [4, 8, 11])
def test_garbled_many_times(layers):
    for text in ("Größe für alle", "schön – über"):
        bad = text
        for i in range(layers):
            bad = garble(bad, "utf-8", "cp1252" if i % 2 else "latin-1")
        new, path = encoding.restore_line(bad)
        assert new == text and len(path) >= layers


def test_a_legacy_misreading_below_layers_of_utf8():
    bad = garble(garble(garble("Проверка очереди после сбоя узла", "cp1251", "cp1252"), "utf-8", "cp1252"), "utf-8", "latin-1")
    new, path = encoding.restore_line(bad)
    assert new == "Проверка очереди после сбоя узла" and path[-1].endswith("cp1251") and len(path) == 3


def test_a_garbled_passage_beside_wide_characters():
    for good, right, wrong in (("Größe und Übung", "cp1252", "mac_roman"), ("Проверка очереди", "cp1251", "latin-1")):
        assert encoding.restore_line(f"東京 の店 {garble(good, right, wrong)}")[0] == f"東京 の店 {good}"
    assert encoding.restore_line("東京 の店 – é")[1] == ()


def test_a_long_line_is_searched_whole():
    good = "x = 1; // Größe für alle Läufe; " * 3000
    assert encoding.restore_line(garble(good, "utf-8", "cp1252"))[0] == good


def test_names_go_by_the_company_of_their_letters():
    names = ["Кшажор Нэртор", "Торжор Нэрфом", "Фомцижор Щущу"]
    known = encoding.Company(dict.fromkeys((x for n in names for x in encoding.company_of(n)), 9))
    for name in names:
        assert encoding.restore_text("Author: " + garble(name, "cp1251", "cp1252"), known)[0] == "Author: " + name


def test_what_only_looks_like_utf8_here_and_there_is_not():
    for name in ("Былци Щущу", "Щукшафом Кшажоржор"):
        assert "瞑" not in encoding.restore_line("Author: " + garble(name, "cp1251", "cp1252"))[0] and "濈" not in encoding.restore_line("Author: " + garble(name, "cp1251", "cp1252"))[0]
    assert encoding.restore_line(garble("їхній буфер після збою вузла", "koi8-u", "cp1251"))[0] == "їхній буфер після збою вузла"
    assert encoding.restore_line("Author: " + garble("郗雾雾", "gb2312", "latin-1"))[0] == "Author: 郗雾雾"
