import random

import numpy as np
import pyarrow as pa

from riskloom.llm import langid as L
from riskloom.llm.common import read, text_slices


def bits(texts):
    return np.concatenate([L.presence(data, offs) for _, _, data, offs in text_slices(pa.array(texts, pa.string()))])


def test_presence_is_of_the_text_alone():
    texts = ["Hello, World", "hello   world", "", "x", "ÉTÉ", "été", None]
    b = bits(texts)
    assert (b[0] == b[1]).all() and (b[4] == b[5]).all() and b[2].sum() == 0
    assert all((x == bits([t])[0]).all() for x, t in zip(b, texts))


def test_with_all_rows_as_landmarks_it_is_exact_kernel_ridge():
    texts = [f"the cat and the dog {i * 37}" for i in range(20)] + [f"le chat et la souris {i * 53}" for i in range(20)]
    b, langs = bits(texts), ["en"] * 20 + ["fr"] * 20
    m = L.fit_rows(np.packbits(b, axis=1), langs, landmarks=40, ridge=1e-2)
    x = b.astype(float)
    x /= np.sqrt(x.sum(1, keepdims=True))
    k = x @ x.T
    y = np.array([[z == "en", z == "fr"] for z in langs], float)
    h = np.eye(40) - 1 / 40
    want = k @ np.linalg.solve(h @ k @ h + 1e-2 * np.eye(40), h @ y)
    got, near = m.scores(b)
    assert (near > 0.3).all()
    assert np.abs((got - got.mean(0)) - (want - want.mean(0))).max() < 0.02


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    model = L.fit(docs.filter("doc_id % 2 = 0"))
    out = L.identified(docs.filter("doc_id % 2 = 1"), model, "p", "s", "r").select("lang", "p").collect()
    assert np.mean([r["lang"] == r["p"] for r in out]) > 0.95


def test_clean_documents_stay_and_foreign_ones_go(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    odd = spark.createDataFrame([(-1, "Привет мир это русский текст для проверки " * 20, "en"), (-2, "の漢字仮名交じり文を書く" * 30, "fr"), (-3, "!!! ??? ###", "en")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in L.language_ids(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()}
    assert not any(out[i]["kept"] for i in (-1, -2, -3)) and np.mean([r["kept"] for i, r in out.items() if i >= 0]) > 0.995


FOREIGN = [
    "La mattina presto il vecchio pescatore scendeva verso il porto e guardava le barche che tornavano cariche di pesce mentre i bambini correvano lungo la strada",
    "Sabah erken saatlerde yaşlı balıkçı limana doğru yürüyor ve balıkla dolu dönen tekneleri izliyordu çocuklar sokak boyunca koşuyor",
    "Varhain aamulla vanha kalastaja käveli satamaan ja katseli veneitä jotka palasivat täynnä kalaa samalla kun lapset juoksivat pitkin katua",
    "Asubuhi na mapema mvuvi mzee alitembea kuelekea bandarini na kutazama mashua zilizokuwa zikirudi zimejaa samaki wakati watoto walikimbia barabarani",
    "Wczesnym rankiem stary rybak szedł w stronę portu i patrzył na łodzie które wracały pełne ryb podczas gdy dzieci biegały wzdłuż ulicy",
    "Sáng sớm người đánh cá già đi về phía bến cảng và nhìn những chiếc thuyền trở về đầy cá trong khi trẻ em chạy dọc con phố",
    "Kora reggel az öreg halász a kikötő felé sétált és nézte a hajókat amelyek tele hallal tértek vissza miközben a gyerekek az utcán futottak",
]


def test_foreign_latin_script_and_letter_junk_go_and_short_clean_texts_stay(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    r = random.Random(5)
    words = lambda letters, n: " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(n))
    abc = "abcdefghijklmnopqrstuvwxyz"
    junk = [words(a, n) for a in (abc, abc + abc.upper() + "0123456789+/", "bcdfghjklmnpqrstvwxz") for n in (15, 100, 2000)]
    odd = [*FOREIGN, *(x[:60] for x in FOREIGN), *((x + " ") * 30 for x in FOREIGN), *junk]
    clean = ["the cat and the dog", "That was in the hand.", "le chat est sur la table", "les uns et les autres", "der Mann und die Frau", "el perro y la casa", "The"]
    new = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(odd)] + [(10**6 + i, t, "en") for i, t in enumerate(clean)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    out = L.identified(new, model, "p", "s", "r").select("doc_id", "text", L.known(model, "s", "r").alias("kept")).collect()
    wrong = [(r["doc_id"], r["text"][:60]) for r in out if r["kept"] != (r["doc_id"] >= 0)]
    assert not wrong


def test_one_language_alone_still_rejects(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").filter("lang = 'en'").select("doc_id", "text", "lang")
    new = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(FOREIGN)], "doc_id long, text string, lang string")
    out = L.language_ids(docs.unionByName(new)).collect()
    assert not any(r["kept"] for r in out if r["doc_id"] < 0) and np.mean([r["kept"] for r in out if r["doc_id"] >= 0]) > 0.99


def test_edges(spark):
    rows = [(i, "the words of one language" if i % 2 else "les mots de la langue", "en" if i % 2 else "fr", 0) for i in range(20)]
    rows += [(None, None, "en", 0), (50, "", "en", 0), (51, "the words", None, 0), (None, "les mots de", "", 0), (1, rows[1][1], "en", 0), (52, "the words of " * 50_000, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = L.language_ids(docs).collect()
    assert len(out) == len(rows) and all(r["kept"] and r["predicted"] is None for r in out if r["doc_id"] is None and r["lang"] == "en")
    assert next(r for r in out if r["doc_id"] == 51)["predicted"] == "en" and not next(r for r in out if r["doc_id"] == 50)["kept"]
    kept = L.in_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out)
    assert L.language_ids(docs.limit(0)).count() == 0 and L.in_known_language(docs.limit(0)).count() == 0
    assert all(r["kept"] for r in L.language_ids(docs.withColumn("lang", docs.lang.substr(9, 1))).collect() if r["doc_id"] != 50)
