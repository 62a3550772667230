"""Damage planted under many chains is found and undone; sound text and quoted examples are not touched."""

import pytest

from lodestitch.llm import encodings as E

CLEAN = {
    "de": "Für jede Änderung müssen die Einträge größer geprüft werden, während „Schlüssel“ fehlt.",
    "fr": "Où se trouve la définition utilisée après l’été ? Déjà vérifiée à côté.",
    "pl": "Później łączy pamięć podręczną, źródłowych plików, błąd należy sprawdzić.",
    "ru": "Повторный запуск занял время, проверка прошла: функция не найдена после загрузки.",
    "sym": "Don’t trust the module’s count (± 28). “Stale” means — 30 °C © authors.",
}


def test_chains_are_inverse():
    for text in CLEAN.values():
        for chain in E.chains():
            g = E.garble(text, chain)
            if g is not None and chain[0] == "utf-8":
                assert E.ungarble(g, chain) == text


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp1252") * 2, ("cp1252", "cp437"), ("cp1251", "koi8-r"), ("cp1251", "cp1252"), ("cp1250", "cp1252")])
def test_planted_damage(spark, chain):
    docs = [(k, t) for k, t in enumerate(list(CLEAN.values()) * 3)]
    bad = {}
    for n, (lang, t) in enumerate(CLEAN.items()):
        g = E.garble(t, chain)
        if g is not None and g != t:
            bad[100 + n] = t
            docs.append((100 + n, g))
    docs += [(200, "The importer showed `Ã¼` where the page had ü."), (201, "bad output '√±', expected ñ"), (202, "NÃO ALTERAR: A FUNÇÃO ESTÁ"), (203, ""), (204, None), (205, "├── src\n│   └── a.ts"), (206, "A lone \ufffd is printed")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, word string")
    hits = E.damaged_words(spark, df)
    assert {r.doc_id for r in E.damaged_documents(hits).collect()} == set(bad)
    restored = {r.doc_id: r.text for r in E.restored(df, hits).collect()}
    exact = sum(restored[d] == t for d, t in bad.items())
    assert exact >= len(bad) - 1  # single characters may stay when several chains are alike


def test_lost_characters(spark):
    docs = [(1, "Für Änderung größer"), (2, "Für Änderung größer"), (3, "F\ufffdr \ufffdnderung gr\ufffd\ufffder 5\ufffd"), (4, "A lone \ufffd here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hits = E.damaged_words(spark, df)
    assert [r.doc_id for r in E.damaged_documents(hits).collect()] == [3]
    row = E.restored(df, hits).first()
    assert row.text == "Für Änderung größer 5\ufffd" and (row.n_restored, row.n_lost) == (3, 1)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert E.damaged_documents(E.damaged_words(spark, df)).count() == 0


def test_copies_of_a_damaged_text_do_not_outvote_the_clean_one(spark):
    clean = "Господин Иванов приехал в Москву вместе с Петровым и Сидоровым"
    bad = E.garble(clean, ("cp1251", "mac_roman"))
    rows = [(0, clean), (1, "sound words only")] + [(k, bad) for k in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hits = E.damaged_words(spark, docs)
    assert {r.doc_id for r in E.damaged_documents(hits).collect()} == set(range(10, 20))
    assert {r.text for r in E.restored(docs, hits).collect()} == {clean}
