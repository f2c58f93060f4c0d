"""Sentences and their language."""

import pytest

from corpusmill.llm import natural, prose

SENTENCES = {
    "en": "The caller must close the file before it is used again.",
    "de": "Diese Datei darf nicht geändert werden, weil sie noch gebraucht wird.",
    "fr": "Si la liste est vide, on passe à la suite sans rien écrire.",
    "es": "Este paso es lento porque la lista se vuelve a crear cada vez.",
    "pt": "Esta parte é lenta porque a fila precisa ser refeita toda vez.",
    "ru": "Нельзя менять список файлов пока он открыт.",
    "zh": "在关闭配置之前不要修改文件列表否则会丢失数据",
    "ja": "設定を読み込み、誤りがないか確認してから返します。",
}
NO = ["SELECT a FROM b WHERE c > 1 ORDER BY d", "for (const x of width) { y(x); }", "git commit -m x --amend && git push", "src/a/b.c lib/d.c e/f.c", "api_key user_name other_key some_value x_y", "if value == NULL) {", "too short a line", "-----BEGIN PRIVATE KEY----- a9B b8C c7D d6E"]


@pytest.mark.parametrize("language", SENTENCES)
def test_languages(language):
    assert prose.spoken([SENTENCES[language]]) == [language]


@pytest.mark.parametrize("text", NO)
def test_no_sentences(text):
    assert prose.spoken([text]) == [None]


def test_operator(spark, files):
    wrapped = "x = 1\n# The caller must hold the\n# lock before it is used.\ny = 'Diese Datei wird von einem anderen Programm geschrieben.'\n"
    df = files((1, "a.py", wrapped), (1, "a.py", wrapped), (2, "b.js", "/** " + SENTENCES["fr"] + " */\nlet a = `" + SENTENCES["ru"] + "`;\n"), (3, "c.json", '{"a": "' + SENTENCES["zh"] + '"}'), (4, "d.yml", "a: " + SENTENCES["es"] + "\n# " + SENTENCES["pt"] + "\n"), (5, "e.py", "# " + SENTENCES["en"] + "\ndef f(:\n"), (6, "f.py", None), (7, "g.py", ""), (8, "h.py", "# return the value of x;\nx = 1\n"), (9, "i.py", "x = 1\n" * 50_000 + "# " + SENTENCES["en"]))
    got = {(r.file_id, r.nl_lang) for r in natural.found(df).collect()}
    assert got == {(1, "en"), (1, "de"), (2, "fr"), (2, "ru"), (3, "zh"), (4, "es"), (4, "pt"), (9, "en")}
    assert all(0 < r.share <= 1 for r in natural.shares(df).collect()) and natural.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Questo file non deve essere cambiato perché la lista viene letta ogni volta.", "Dit bestand mag niet worden gewijzigd omdat het nog door de lijst wordt gebruikt.", "Den här filen får inte ändras eftersom den fortfarande används av listan.", "Tego pliku nie można zmieniać, ponieważ jest on nadal używany przez listę."])
def test_other_languages_are_none(text):
    assert prose.spoken([text]) == [None]
