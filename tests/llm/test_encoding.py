import pytest

from semantide.llm.encoding import CHAINS, SEEDS, SYMBOLS, Classifier, garble, garbled, restore

# Not among the training sentences.
HELD_OUT = [
    "Während der Übertragung dürfen keine größeren Änderungen über die Schnittstelle möglich sein",
    "A configuração não está disponível porque você já começou a operação três vezes",
    "Después de la validación según el índice, el tamaño máximo también será pequeño",
    "Проверка завершена, результат сохранён в таблицу для следующего шага программы",
    "如果输入为空就返回错误 否则更新缓存并且继续处理下一条记录",
    "入力が空のときはエラーを返す それ以外は次の行を処理する",
    "Il problema è che la qualità non può più essere verificata perché è già tardi",
]


@pytest.fixture(scope="module")
def model():
    return Classifier()


@pytest.mark.parametrize("chain", CHAINS)
def test_every_chain_is_undone_exactly(chain):
    for line in SEEDS + HELD_OUT:
        try:
            broken = garble(line, chain)
        except UnicodeError:
            continue
        assert restore(broken, chain) == line


def test_held_out_sentences_are_found_and_restored(model):
    tried = found = exact = 0
    for chain in CHAINS:
        if chain[0][0] != "utf-8":
            continue
        for line in HELD_OUT:
            try:
                broken = garble(line, chain)
            except UnicodeError:
                continue
            tried += 1
            verdict = model.diagnose("# " + broken)
            found += verdict[0] == "garbled"
            exact += verdict[2] == "# " + line
    assert tried > 50
    assert found / tried > 0.95
    assert exact / tried > 0.9


def test_other_chains_of_long_lines(model):
    for chain in ((("koi8-r", "cp1251"),), (("cp1251", "latin-1"),), (("gbk", "latin-1"),)):
        line = HELD_OUT[3] if chain[0][0] != "gbk" else HELD_OUT[4]
        assert model.diagnose(garble(line, chain))[2] == line


def test_unharmed_text_is_left_alone(model):
    for line in SEEDS + HELD_OUT + SYMBOLS + ["Ð and Ñ stay", "ÄÖÜ ÃÕ Å", "×÷±°", "½ § © ¥", "print(“a”, b)", "x = 5 # °C"]:
        assert model.diagnose(line)[0] == "", line


WESTERN = [c for c in CHAINS if c[0][0] in ("cp1252", "mac-roman", "cp437", "cp850")]


def test_short_damage_is_judged_over_the_record(spark):
    german = "# für die Prüfung\nx = 1\n# größere Werte zurückgeben, möglichst früh\ny = 2  # é\n"
    spanish = "// validación según el índice\nint x;\n// tamaño máximo también\n"
    bad = [garble(t, c) for c in WESTERN for t in (german, spanish)]
    bad += [garble("# проверка\nx = 1\n", (p,)) for p in (("cp1251", "latin-1"), ("koi8-r", "cp1251"))] + [garble("x = 1\n# ошибка\n# строка\n", (("cp1251", "latin-1"),))]
    good = [german, spanish, "# café Škoda Žižek\n# Šimon\n", "# n×m, 10³ km², a÷b → c\n# Θ(n) and Ω(n), x‰y\n", "# õhtu, või, müük\n# naïve façade\n", "# ошибка\n", "# ÄÖÜ ÃÕ Å ÉÈÊ\n"]
    out = {r["id"] for r in garbled(spark.createDataFrame(list(enumerate(bad + good)), "k long, code string"), "k", "code").collect()}
    assert out == set(range(len(bad))), (sorted(set(range(len(bad))) - out), [(bad + good)[k] for k in sorted(out) if k >= len(bad)])


def test_table_form_and_edge_cases(spark):
    good, bad = "x = 1  # größe", "x = 1  # " + garble("größere Schlüssel", (("utf-8", "cp1252"),)) + "\ny = 2\r\n"
    rows = [(1, good, "a"), (2, bad, "b"), (3, None, "c"), (4, "", "d"), (5, "# L��cke schlie��en", "e"), (6, bad * 2000, "f")]
    out = {r["id"]: r for r in garbled(spark.createDataFrame(rows, "k long, code string, text string"), "k", "code").collect()}
    assert set(out) == {2, 5, 6}
    assert out[2]["restored"] == "x = 1  # größere Schlüssel\ny = 2\r\n" and out[2]["chain"] == "utf-8/cp1252"
    assert out[5]["lost_lines"] == 1 and out[5]["restored"] == "# L��cke schlie��en"
    assert out[6]["garbled_lines"] == 2000
    assert garbled(spark.createDataFrame([], "k long, code string"), "k", "code").count() == 0


SHORT = [
    ("Привет", (("cp1251", "latin-1"),)), ("Ошибка", (("koi8-r", "cp1251"),)), ("Größe prüfen", (("cp1252", "cp437"),)), ("Ελληνικό κείμενο ελέγχου", (("iso8859-7", "latin-1"),)),
    ("בדיקה של הטקסט", (("utf-8", "cp1255"),)), ("فحص النص العربي", (("cp1256", "latin-1"),)), ("für die Prüfung", (("cp1252", "cp1251"),)), ("más según", (("cp1252", "mac-roman"),)),
]


@pytest.mark.parametrize("text, chain", SHORT)
def test_short_lines_of_many_scripts_are_restored(model, text, chain):
    assert model.diagnose("# " + garble(text, chain))[2] == "# " + text


def test_chains_that_are_not_known_are_never_restored_to_something_else(model):
    for text, chain in (("проверка текста", ("iso8859-5", "latin-1")), ("Ελληνικό κείμενο ελέγχου", ("iso8859-7", "cp1251")), ("проверка завершена", ("mac-cyrillic", "cp1252")), ("בדיקה של הטקסט", ("iso8859-8", "cp1251"))):
        try:
            broken = "# " + garble(text, (chain,))
        except UnicodeError:
            continue
        assert model.diagnose(broken)[2] in (None, "# " + text), (text, chain, model.diagnose(broken))


def test_training_on_the_records_own_lines(spark):
    lines = [f"# {w} und größere Übung {k}" for k, w in enumerate("süße Bäume für grüne Hügel schöne Flüsse".split() * 8)] + [f"# 记录{k}号 已经删除 队列为空" for k in range(40)]
    df = spark.createDataFrame([(k, x + "\r\nx = 1\n" + x) for k, x in enumerate(lines)] + [(900, None), (901, "plain"), (902, "é" * 500)], "k long, code string")
    from semantide.llm import encoding

    sample = encoding.sample_lines(df, "code")
    assert sorted(sample) == sorted(set(lines))
    shares = encoding.held_out(sample)
    assert sum(r[3] for r in shares) >= 0.95 * sum(r[2] for r in shares) and sum(r[5] for r in shares) <= 0.01 * sum(r[2] for r in shares)
