import datetime
import hashlib
import re
import time

import pytest

from surveyspark.llm import pii

KEY = "k"


def replaced(spark, values, key=KEY):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymise(rows, key).orderBy("doc_id").collect()]


def plain_feistel(left, right, a, b, kind, tweak):
    for i in range(pii.ROUNDS):
        other = right if i % 2 == 0 else left
        h = int(hashlib.sha256(f"{KEY}|{kind}|{tweak}|{i}|{other}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + h % a) % a
        else:
            right = (right + h % b) % b
    return left, right


def plain_digits(d, kind):
    n, low = len(d), len(d) // 2
    a, b = 10 ** (n - low), 10**low
    left, right = plain_feistel(int(d) // b, int(d) % b, a, b, kind, n)
    return f"{left * b + right:0{n}d}"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10


def plain_card(m):
    d = re.sub("[^0-9]", "", m)
    if luhn(d):
        return m
    payload = plain_digits(d[:-1], "card")
    new = iter(payload + str(-luhn(payload + "0") % 10))
    return re.sub("[0-9]", lambda _: next(new), m)


CARDS = ["4539578763621486", "4111 1111 1111 1111", "3782-822463-10005", "6011000990139424", "4222222222222", "4111111111111112"]


def test_cards_against_plain_python(spark):
    assert replaced(spark, CARDS) == [plain_card(c) for c in CARDS]
    for old, new in zip(CARDS[:-1], replaced(spark, CARDS)):
        assert old != new and luhn(re.sub("[^0-9]", "", new)) == 0 and re.sub("[0-9]", "9", old) == re.sub("[0-9]", "9", new)


def test_dates_and_addresses(spark):
    got = replaced(spark, ["born 1984-02-29.", "on 31/12/1999", "on 12/31/1999", "am 01.02.2003", "1984-02-30", "99/99/2000",
                           "10.1.2.3", "256.1.1.1", "1.2.3.4.5", "3001-01-01"])
    assert datetime.date.fromisoformat(got[0][5:15]) and got[0][:5] == "born " and got[0][15:] == "." and "1984-02-29" not in got[0]
    assert datetime.datetime.strptime(got[1][3:], "%d/%m/%Y") and datetime.datetime.strptime(got[2][3:], "%m/%d/%Y")
    assert datetime.datetime.strptime(got[3][3:], "%d.%m.%Y") and got[3] != "am 01.02.2003"
    assert got[4] == "1984-02-30" and got[5] == "99/99/2000" and got[7] == "256.1.1.1" and got[8] == "1.2.3.4.5"
    assert got[9] == "3001-01-01"
    left, right = plain_feistel(10 * 256 + 1, 2 * 256 + 3, 65536, 65536, "ip", "")
    assert got[6] == f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"


def test_every_date_of_the_range_is_hit_once(spark):
    days = spark.range(pii.DAYS_A * pii.DAYS_B).selectExpr(
        "id doc_id", "date_format(date_add(date'1800-01-01', cast(id as int)), 'yyyy-MM-dd') text")
    out = pii.pseudonymise(days, KEY)
    assert out.select("text").distinct().count() == pii.DAYS_A * pii.DAYS_B
    assert out.selectExpr("min(text)", "max(text)").first()[:] == ("1800-01-01", "2199-12-31")


def test_numbers_with_areas(spark):
    got = replaced(spark, ["123-45-6789", "000-45-6789", "666-45-6789", "901-45-6789", "123-00-6789", "123-45-0000",
                           "+1 (017) 555-7713", "(212) 555-0100", "212-555-0100", "+49 30 123 4567"])
    area, group, serial = map(int, got[0].split("-"))
    assert got[0] != "123-45-6789" and 0 < area < 900 and area != 666 and group and serial
    assert got[1:6] == ["000-45-6789", "666-45-6789", "901-45-6789", "123-00-6789", "123-45-0000"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[6]) and got[6] != "+1 (017) 555-7713"
    assert got[6][4:].replace("(", "").replace(")", "").replace(" ", "").replace("-", "") == plain_digits("0175557713", "phone")
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", got[7]) and got[7] != "(212) 555-0100" and got[8] != "212-555-0100"
    assert got[9].startswith("+49 ") and got[9] != "+49 30 123 4567"


def test_iban(spark):
    (new, bad) = replaced(spark, ["DE89370400440532013000", "DE88370400440532013000"])
    number = int("".join(str(int(c, 36)) for c in new[4:] + new[:4]))
    assert new[:2] == "DE" and len(new) == 22 and new != "DE89370400440532013000" and number % 97 == 1
    assert bad == "DE88370400440532013000"
    (gb,) = replaced(spark, ["GB29NWBK60161331926819"])
    assert gb[4:8] == "NWBK" and int("".join(str(int(c, 36)) for c in gb[4:] + gb[:4])) % 97 == 1


def test_mail_and_secrets(spark):
    h = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"
    got = replaced(spark, ["Mail a.b+c@x-y.example.com.", "MAIL A.B+C@X-Y.EXAMPLE.COM.", f'token = "{h}"###', h.upper(),
                           "AKIA" + "Q" * 16, "ghp_" + "a" * 36])
    assert "@x-y" not in got[0] and got[0][5:] == got[1][5:] and got[0].endswith("@pseudonym.invalid.")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', got[2]) and h not in got[2]
    assert got[3] == got[2][9:49].upper()
    assert got[4].startswith("AKIA") and len(got[4]) == 20 and got[5].startswith("ghp_") and len(got[5]) == 40


def test_secrets_without_digits_in_texts_without_digits(spark):
    old = ["key AKIA" + "Q" * 16 + ".", "key ASIA" + "QWERTYUI" * 2, "token " + "abcdefAB" * 4]
    alone, beside = replaced(spark, old), replaced(spark, [x + " 7" for x in old])
    for text, new, other in zip(old, alone, beside):
        assert new != text and other == new + " 7"


def test_links_keys_counts_and_columns(spark):
    rows = [(1, "card 4539578763621486, again 4539578763621486", 5, "x"), (2, "4539578763621486", 1, None), (3, None, 0, "x"),
            (4, "", 0, "x"), (4, "", 0, "x"), (None, "nothing", 0, "x"), (5, "a " * 500_000 + "10.1.2.3", 0, "x"),
            (6, "9z" * 50_000 + " " + "z" * 200_000 + "@", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int, gaps_0 string")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "found", "gaps_0", "n_replaced"]
    got = {r["doc_id"]: r for r in out.collect()}
    card = got[2]["text"]
    assert got[1]["text"] == f"card {card}, again {card}" and got[1]["n_replaced"] == 2 and got[1]["found"] == 5
    assert got[3]["text"] is None and got[3]["n_replaced"] == 0 and got[4]["text"] == "" and got[None]["text"] == "nothing"
    assert got[5]["text"].startswith("a a ") and got[5]["n_replaced"] == 1 and got[6]["text"] == rows[7][1]
    assert out.count() == len(rows)
    other = pii.pseudonymise(df, "other key").where("doc_id = 2").first()["text"]
    assert other != card and luhn(other) == 0
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


def test_plan_is_native(spark):
    from surveyspark.plans import plan_text

    plan = plan_text(pii.pseudonymise(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), KEY))
    assert not re.search("Python|Arrow|Exchange", plan)


@pytest.mark.parametrize("table", ["/root/testdata/sf0.01/documents.parquet"])
def test_no_planted_value_survives(spark, table):
    docs = spark.read.parquet(table)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, KEY).collect()}
    patterns = [r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])",
                r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)"]
    for i, text in before.items():
        values = [m for p in patterns for m in re.findall(p, text)]
        values += [m for m in re.findall(r"(?<!\w)\d{16}(?!\w)", text) if luhn(m) == 0]
        assert not any(v in after[i] for v in values)
        if not values:
            assert after[i] == text


def test_long_runs_neither_overflow_nor_stall(spark):
    texts = ["x@" + "a." * 100_000 + "com", "y" * 300_000, "a" * 300_000, "1" * 300_000, "é" * 300_000 + "1", "1." * 150_000,
             "+1 " * 100_000, "AB12" * 75_000, "x@" * 150_000, "1-" * 150_000, "4111 " * 60_000]
    began = time.time()
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert time.time() - began < 60
    assert got[0]["text"].endswith("@pseudonym.invalid") and got[0]["n_replaced"] == 1
    assert [r["text"] == t for r, t in zip(got, texts)][1] and got[4]["text"] == texts[4]


def test_phones_of_other_countries(spark):
    old = ["call +44 20 7946 0958 now", "+49 30 12345678", "+33 1 23 45 67 89", "06 12 34 56 78", "+442079460958", "+15551234567",
           "+1 555 123 4567", "+353 1 234 5678", "+1 555 123 4567 2024", "01.02.2003", "1.06.12.34.56.78", "+12", "+33-1.23.45.67.89",
           "+442079460958, or +44 (20) 7946-0958"]
    new = replaced(spark, old)
    digits = [re.sub("[^0-9]", "", x) for x in new]
    for i in (0, 1, 2, 3, 4, 5, 6, 7, 12):
        assert new[i] != old[i] and re.sub("[0-9]", "9", new[i]) == re.sub("[0-9]", "9", old[i])
    assert [new[i][at:at + 3] for i, at in ((0, 5), (1, 0), (2, 0), (4, 0))] == ["+44", "+49", "+33", "+44"]
    assert new[5][:2] == new[6][:2] == "+1" and new[7][:4] == "+353"
    assert digits[0] == digits[4] and digits[5] == digits[6] and digits[2] == digits[12]  # linked
    assert digits[5][1:] == plain_digits("5551234567", "phone")
    assert new[8] == new[6] + " 2024" and new[10:12] == old[10:12]
    assert digits[13] == digits[4] * 2


def test_printed_ibans(spark):
    printed, compact = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    (a, b, bad, within, letters) = replaced(spark, [printed, compact, printed.replace("89", "88"), f"to {printed}.",
                                                    "GB29 NWBK 6016 1331 9268 19"])
    assert a.replace(" ", "") == b != compact and [len(g) for g in a.split(" ")] == [4, 4, 4, 4, 4, 2]
    assert bad == printed.replace("89", "88") and within == f"to {a}."
    assert letters[5:9] == "NWBK" and letters != "GB29 NWBK 6016 1331 9268 19"
    number = letters.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def test_long_runs_of_new_formats_do_not_stall(spark):
    texts = ["+33 1 " * 60_000, "06 " * 100_000, "DE89 3704 " * 40_000, "+1234567" * 40_000, "ABCD " * 60_000]
    began = time.time()
    replaced(spark, texts)
    assert time.time() - began < 40
