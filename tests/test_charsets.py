import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beaconaudit import detect
from beaconaudit.plans.scan import scan_files
from beaconaudit.sources import charsets, corpus

# Sentences as they stand in code and messages, and charsets they are written in (codec here -> name).
SENTENCES = [
    ("Съешь же ещё этих мягких французских булок, да выпей чаю.", {"cp1251": "windows-1251", "koi8_r": "KOI8-R"}),
    ("// ошибка", {"cp1251": "windows-1251"}),
    ("logger.info('Пользователь вошёл');", {"cp1251": "windows-1251", "koi8_r": "KOI8-R"}),
    ("Το σφάλμα σύνδεσης με τον διακομιστή δεν είναι διαθέσιμο αυτή τη στιγμή.", {"cp1253": "windows-1253"}),
    ("שגיאה בחיבור לשרת, נסה שוב מאוחר יותר", {"cp1255": "windows-1255"}),
    ("خطأ في الاتصال بالخادم، حاول مرة أخرى لاحقا", {"cp1256": "windows-1256"}),
    ("Zażółć gęślą jaźń, proszę spróbować ponownie później", {"cp1250": "windows-1250"}),
    ("Příliš žluťoučký kůň úpěl ďábelské ódy, chyba při připojení k serveru", {"cp1250": "windows-1250"}),
    ("Une erreur s'est produite à la connexion, veuillez réessayer là où ça l’a été", {"cp1252": "windows-1252"}),
    ("Der Größe nach übertrüge ein Fehler die Prüfung für Schlüssel", {"latin-1": "windows-1252"}),
    ("El niño pequeño comió mañana, ¿qué pasó? ¡la conexión falló!", {"latin-1": "windows-1252"}),
    ("L'utente non è più attivo perché la città è già così", {"latin-1": "windows-1252"}),
    ("Ett fel uppstod när användaren försökte öppna filen på åtta ställen", {"latin-1": "windows-1252"}),
    ("èêai èêai de èêai", {"latin-1": "windows-1252"}),
    ("Villa kom upp við að tengjast þjóninum, reyndu aftur síðar", {"latin-1": "windows-1252"}),
    ("Sunucuya bağlanırken bir hata oluştu, lütfen daha sonra tekrar deneyiniz", {"cp1254": "windows-1254"}),
    ("サーバーへの接続中にエラーが発生しました。後でもう一度お試しください。", {"cp932": "windows-31j", "euc_jp": "EUC-JP"}),
    ("// ユーザー情報を取得する", {"cp932": "windows-31j", "euc_jp": "EUC-JP"}),
    ("// 接続失敗", {"cp932": "windows-31j", "euc_jp": "EUC-JP"}),
    ("连接服务器时发生错误，请稍后重试。用户的信息已经保存在本地。", {"gbk": "GB18030"}),
    ("連接伺服器時發生錯誤，請稍後再試。使用者的資訊已經儲存在本機。", {"big5": "Big5"}),
    ("서버에 연결하는 동안 오류가 발생했습니다. 나중에 다시 시도하십시오.", {"euc_kr": "x-windows-949"}),
    ("wide é 日本 😀", {"utf-16": "UTF-16LE", "utf-32": "UTF-32LE", "utf-8": "UTF-8"}),
]


def decode(spark, *contents):
    """(charset, text) of every content, in order."""
    files = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "i int, content binary")
    return [(r["charset"], r["content"]) for r in charsets.decoded(charsets.with_charset(files)).orderBy("i").collect()]


def test_sentences(spark):
    cases = [(name, text, text.encode(codec)) for text, kinds in SENTENCES for codec, name in kinds.items()]
    assert decode(spark, *(raw for *_, raw in cases)) == [(name, text) for name, text, _ in cases]


def test_odd_contents(spark):
    found = decode(spark, None, b"", b"plain", b"a\x00b\x00", b"\xff\xfe", b"\xfe\xff\x00a\x00", b"\xef\xbb\xbfabc", b"\x81\x8d x \xff", b"\xe9")
    assert found[:4] == [(None, None), ("UTF-8", ""), ("UTF-8", "plain"), ("UTF-8", "a\x00b\x00")]
    assert found[4] == ("UTF-16LE", "") and found[5][0] == "UTF-16BE" and found[5][1][0] == "a"
    assert found[6] == ("UTF-8", "\ufeffabc") and found[7][0] == charsets.FALLBACK and len(found[7][1]) == 6
    assert found[8] == (charsets.FALLBACK, "é")


def test_every_byte_means_something(spark):
    every = bytes(range(256))
    for name, codec, *_ in (*charsets.ALPHABETS, *charsets.LATIN):
        with charsets.java_charsets(spark):
            text = spark.createDataFrame([(bytearray(every),)], "x binary").select(charsets.text_of(F.col("x"), F.lit(name))).first()[0]
        assert len(text) == 256 and all(text[i] == every[i:i + 1].decode(codec, "ignore") or i >= 0x80 for i in range(256))
        assert "".join(c for c in text if c.encode(codec, "ignore")).encode(codec) == bytes(b for b in every if every[b:b + 1].decode(codec, "ignore"))


def test_a_long_text_is_read_whole(spark):
    text = "x = 1; " * 200_000 + "// ошибка подключения к серверу"
    assert decode(spark, text.encode("cp1251")) == [("windows-1251", text)]
    wide = "の日本" * 300_000
    assert decode(spark, wide.encode("cp932")) == [("windows-31j", wide)]


def test_session_is_left_as_it_was(spark):
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    decode(spark, "日本語の".encode("euc_jp"))
    assert [spark.conf.get(n, None) for n in names] == [None, None]
    spark.conf.set(names[0], "false")
    with pytest.raises(ValueError), charsets.java_charsets(spark):
        raise ValueError
    assert spark.conf.get(names[0]) == "false"
    spark.conf.unset(names[0])


def test_code_in_wide_characters_is_scanned(spark):
    code = "using Datadog.Unity;\r\nlogger.Info(\"größe\");\r\n// 日本\r\n"
    files = [(f"/r/p/Assets/{codec}.cs", bytearray(code.encode(codec))) for codec in ("utf-16", "utf-32", "utf-8")]
    frame = spark.createDataFrame([("/r/p", *f) for f in files], "project_path string, path string, content binary")
    found = scan_files(frame, base_url="https://github.com/example").select("file_path", "line_number", "code_snippet")
    want = {(1, "using Datadog.Unity;"), (2, "logger.Info(\"größe\");")}
    assert {r["file_path"] for r in found.collect()} == {f for f, _ in files}
    assert {(r["line_number"], r["code_snippet"]) for r in found.collect()} == want


def test_bytes_are_decoded_once(spark, tmp_path):
    files = spark.createDataFrame([("/r/p/a.ts", bytearray(b"datadog \xe9"))], "path string, content binary")
    files.write.parquet(str(tmp_path / "files"))
    plan = corpus.keyword_filter(corpus.decoded(spark.read.parquet(str(tmp_path / "files"))).where(F.length("content") > 0))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("is_valid_utf8") + text.count("isValid") == 1, text
    assert detect(plan).count() == 0


def test_scores_need_only_what_is_near_high_bytes(spark):
    rng, texts = random.Random(5), []
    for _ in range(300):
        parts = [bytes(rng.choice((rng.randrange(256), rng.randrange(0x80, 256), rng.choice(b"aZ09 \n"))) for _ in range(rng.randint(1, 12)))
                 if rng.random() < 0.6 else rng.choice((b"x", b"ab 1", b"long plain text\n")) * rng.randint(1, 6) for _ in range(rng.randint(1, 8))]
        texts.append(b"".join(parts))
    texts += [b"plain " * 2000 + text.encode(codec) + b"\nplain" * 2000 for text, kinds in SENTENCES for codec in kinds if not codec.startswith("utf")]
    views = spark.createDataFrame([(t.decode("latin-1"),) for t in texts], "v string")
    near = views.withColumn("n", charsets._near_high(F.col("v")))
    found = near.select("v", "n", charsets._guess(F.col("v")).alias("whole"), charsets._guess(F.col("n")).alias("near")).collect()
    assert all(r["whole"] == r["near"] for r in found) and len({r["near"] for r in found}) > 5
    assert max(len(r["n"]) for r in found) < 400 < max(len(r["v"]) for r in found)


def by_patterns(raw):
    """The charset that bytes look like, by patterns over all of them."""
    def count(pattern):
        return len(re.findall(pattern, raw))

    def some(characters, codec):
        return b"[" + b"".join(b"\\x%02x" % c.encode(codec)[0] for c in characters if c.encode(codec, "ignore")) + b"]"

    def beside(x):
        return count(rb"(?<=[A-Za-z])%b|(?<=[A-Za-z][\x80-\xff])%b|%b(?=[\x80-\xff]?[A-Za-z])|(?<![\x80-\xff])%b(?![\x80-\xff])" % (x, x, x, x))

    def kept(wanted, unit):
        return sum(len(m[1] or b"") for m in re.finditer(rb"(?s)(%b)|%b|." % (wanted, unit), raw))

    high, scores = max(count(rb"[\x80-\xff]"), 1), []
    for name, codec, usual, rare in charsets.LATIN:
        opening = count(rb"(?<![A-Za-z\x80-\xff])[\xa1\xbf](?=[A-Za-z])") if codec == "cp1252" else 0
        scores.append((name, (beside(some(usual, codec)) + 0.4 * beside(some(rare, codec)) + opening) / high))
    for name, codec, one, unit, common, frequent in charsets.DOUBLE_BYTE:
        unit, common = unit.encode(), common.encode()
        wrong = len(re.sub(rb"[\x00-\x7f]+|%b|%b\Z" % (unit, b"[%b]|" % one.encode() if one else b""), b"", raw))
        top = b"|".join(re.escape(c.encode(codec)) for c in frequent)
        scores.append((name, (kept(common, unit) / 2 + kept(top, unit) - 8 * wrong) / max(count(unit), 1)))
    for name, codec, frequent in charsets.ALPHABETS:
        is_ = [bytes([c]).decode(codec, "ignore") or chr(c) for c in range(0x80, 0x100)]
        letter, small, capital, unknown = (b"[" + b"".join(b"\\x%02x" % (0x80 + i) for i, c in enumerate(is_) if test(i, c)) + b"]" for test in (
            lambda i, c: c in frequent, lambda i, c: c.islower(), lambda i, c: c.isupper(), lambda i, c: c == chr(0x80 + i) and i != 0x20))
        turned = count(small + capital) if small != b"[]" and capital != b"[]" else 0
        scores.append((name, (count(letter + b"(?=" + letter + b")") + count(letter) / 2 - (count(unknown) if unknown != b"[]" else 0) - turned) / high))
    best = max(score for _, score in scores)
    return next(name for name, score in scores if score == best) if best >= 0.2 else charsets.FALLBACK


def odd_texts():
    rng = random.Random(8)
    pools = [range(256), range(0x80, 0x100), (0x81, 0x30, 0x39, 0xFE, 0x40), (0x8F, 0xA1, 0xFE), (0x8E, 0xA1, 0xDF, 0xE0, 0x8F), (0xE0, 0x7F, 0x82, 0x80, 0xFC),
             [*range(0x40, 0x60), *range(0xA1, 0xFF)], [*b"aZ09 \n", *range(0xC0, 0x100)]]
    texts = [bytes(rng.choice(pool) for pool in rng.choices(pools, k=rng.randint(1, 3)) for _ in range(rng.choice([1, 2, 3, 9, 40]))) for _ in range(1200)]
    whole = [text.encode(codec) for text, kinds in SENTENCES for codec in kinds if not codec.startswith("utf")]
    return texts + whole + [w[1:] for w in whole] + [b" ".join(rng.choices(whole, k=3)) for _ in range(60)] + [b"", b"plain"]


def named(texts):
    rows = [{"name": None, "content": t} for t in texts]
    return charsets._names(pa.array(rows, pa.struct([("name", pa.string()), ("content", pa.binary())]))).to_pylist()


@pytest.mark.parametrize("together, pieces", [(1 << 17, 512), (5, 3)])
def test_counted_scores_are_those_of_patterns(monkeypatch, together, pieces):
    monkeypatch.setattr(charsets, "_TOGETHER", together)
    monkeypatch.setattr(charsets, "_PIECES", pieces)
    texts = odd_texts()
    found = named(texts)
    assert found == [by_patterns(t) for t in texts]
    assert {name for name, *_ in (*charsets.LATIN, *charsets.DOUBLE_BYTE, *charsets.ALPHABETS)} == set(found)
    assert named([]) == []


def test_what_is_known_is_not_scored():
    rows = [{"name": "UTF-8", "content": None}, {"name": None, "content": None}, {"name": None, "content": b"caf\xe9"}]
    assert charsets._names(pa.array(rows, pa.struct([("name", pa.string()), ("content", pa.binary())]))).to_pylist() == ["UTF-8", None, "windows-1252"]


def test_charset_is_found_once_for_name_and_text(spark):
    files = spark.createDataFrame([(i, bytearray(text.encode(codec))) for i, (text, kinds) in enumerate(SENTENCES) for codec in kinds], "i int, content binary")
    plan = corpus.decoded(charsets.with_charset(files), charset="charset")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("is_valid_utf8") + text.count("isValid") == 1 and text.count("ArrowEvalPython") == 1, text
    assert "regexp_count" not in text
    both = corpus.decoded(charsets.with_charset(files))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, both.collect()))
