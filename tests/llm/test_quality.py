import random
import re

from assay.llm.quality import labelling_functions, learn, text_statistics, text_types

PROSE = "The first page went to the billing team at 13:01, when alerts arrived late. Customers of the service saw the effect first in the east, where the budget is smallest. "


def docs():
    rnd = random.Random(4)
    word = lambda: rnd.choice("search index login gateway mail relay check replica noisy shard mirror tenant ledger".split())
    out = []
    for i in range(40):
        out.append(("prose", PROSE * rnd.randint(1, 6)))
        out.append(("prose", (PROSE * 3).lower().replace(".", "").replace(",", "")))
        out.append(("list", "\n".join(f"{rnd.choice(['-', '*'])} {word()} {word()}" for _ in range(20))))
        out.append(("list", "Open points\n" + "\n".join(f"{word()}: {word()} {word()}" for _ in range(15))))
        out.append(("table", "\n".join(" | ".join(str(rnd.randint(0, 99)) for _ in range(5)) for _ in range(12))))
        out.append(("table", "\n".join(";".join([word(), str(rnd.randint(0, 99)), "2020-01-02", "west"]) for _ in range(12))))
        out.append(("junk", " ".join("".join(rnd.choice("bcdfghjkxzw") for _ in range(rnd.randint(3, 12))) for _ in range(60))))
        out.append(("junk", rnd.choice(["~.", "%$&", "digest, ", "cursor"]) * 90))
    out.append(("prose", "原因は、設定の変更が検証されないまま全台に配られたことだった。担当者は変更を元に戻し、残った10台を順番に再起動した。" * 3))
    out.append(("prose", "La cause était un verrou posé par une migration sur la plus grande table. L'équipe a annulé le changement, puis elle a vidé la file. " * 3))
    out.append(("prose", PROSE * 4 + "\n- search index\n- mail relay\n| a | b |\n| 1 | 2 |\n" + PROSE * 4))
    return out


def test_types(spark):
    data = docs()
    df = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(data)], "doc_id bigint, text string, kind string")
    got = {r.id: r.kind for r in text_types(df).collect()}
    wrong = [(k, got[i], t[:60]) for i, (k, t) in enumerate(data) if got[i] != k]
    assert len(wrong) <= 0.01 * len(data), wrong


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat sat.\nA dog!\n\n- x y"), (2, None), (3, "")], "doc_id bigint, text string")
    s = {r.id: r for r in text_statistics(df).collect()}
    assert (s[1].n_words, s[1].n_lines, s[1].n_chars) == (7, 3, 26) and abs(s[1].closed_lines - 2 / 3) < 1e-9
    assert abs(s[1].mean_word_length - 15 / 7) < 1e-9
    assert s[2].n_chars == 0 and s[2].n_words == 0 and s[2].symbol_ratio is None and s[3].mean_line_words is None


def test_cases(spark):
    long = ["|" * 60000, "a'" * 40000, "-" * 50000, "x\ty" * 20000, "word " * 40000, "a;b" * 30000, "(" * 30000, "q w  " * 20000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " \n", *long])] + [(None, PROSE), (0, PROSE)], "doc_id bigint, text string")
    out = text_types(df).collect()
    assert len(out) == len(long) + 5 and {r.kind for r in out if r.id in (1, 2)} == {"junk"}
    assert text_types(df.limit(0)).count() == 0


def test_learning(spark):
    names = list(labelling_functions())
    none = (None,) * len(names)
    post = learn([(("prose", *none[1:]), 50), (("prose", "prose", *none[2:]), 50), (("junk", "junk", *none[2:]), 10)])
    assert post[("junk", "junk", *none[2:])].argmax() == 3 and post[("prose", *none[1:])].argmax() == 0
    assert learn([]) == {}


def test_long_cells_and_entries(spark):
    long = "The first page went to the billing team at noon and the alerts of the service arrived late in the east"
    words = "search index login gateway mail relay check replica noisy shard mirror tenant ledger".split()
    texts = {
        "in_bar": "\n".join(f"| {w} | {long} {w} | {i} |" for i, w in enumerate(words)), "in_tab": "\n".join(f"{w}\t{long} {w}\t{i}" for i, w in enumerate(words)),
        "in_separated": "\n".join(f"{w},{long} {w},{i}" for i, w in enumerate(words)), "in_marked": "\n".join(f"- {long} {w} and then {long.lower()}." for w in words),
        "in_keyed": "\n".join(f"{w}: {long} {w}" for w in words), "wide": "\n".join("|".join(str(i) for i in range(300)) for _ in range(4)),
    }
    prose = "\n".join([PROSE * 3] * 4) + "\n\tIt said\tso; and; so; on\n"
    df = spark.createDataFrame([*texts.items(), ("prose", prose)], "doc_id string, text string")
    got = {r.id: r for r in text_statistics(df).collect()}
    for k in texts:
        assert got[k]["in_bar" if k == "wide" else k] > 0.9, k
    assert all(got["prose"][k] < 0.2 for k in ("in_bar", "in_tab", "in_separated", "in_marked", "in_keyed"))
    many = spark.createDataFrame([("few", " ".join(rnd) * 1) for rnd in [random.Random(3).choices(words, k=9000)]], "doc_id string, text string")
    assert [r.v for r in text_statistics(many).select(labelling_functions()["cycle"].alias("v")).collect()] == ["junk"]


def test_prose_in_languages_nobody_listed(spark):
    texts = [
        "Причиной сбоя стал неверный параметр конфигурации. Команда заметила его слишком поздно, и очередь росла несколько часов. После отката служба снова заработала.",
        "Przyczyną awarii był błędny parametr konfiguracji. Zespół zauważył go zbyt późno, a kolejka rosła przez kilka godzin. Po wycofaniu zmiany usługa znów działała.",
        "Kesintinin nedeni hatalı bir yapılandırma oldu. Ekip bunu çok geç fark etti ve kuyruk saatlerce büyüdü. Değişiklik geri alınınca hizmet yeniden çalıştı.",
        "Häiriön syynä oli virheellinen asetus. Ryhmä huomasi sen liian myöhään, ja jono kasvoi useita tunteja. Muutoksen perumisen jälkeen palvelu toimi taas.",
        "كان سبب العطل إعدادا خاطئا. لاحظه الفريق متأخرا جدا، ونما الطابور لعدة ساعات. بعد التراجع عن التغيير عادت الخدمة إلى العمل.",
        "장애의 원인은 잘못된 설정이었다. 팀은 너무 늦게 알아차렸고 대기열은 몇 시간 동안 늘어났다. 변경을 되돌린 뒤 서비스가 다시 동작했다.",
        "故障的原因是一个错误的配置参数。团队发现得太晚，队列增长了好几个小时。回滚更改之后，服务恢复正常。",
        "व्यवधान का कारण एक गलत विन्यास था। दल ने इसे बहुत देर से देखा और कतार कई घंटों तक बढ़ती रही। परिवर्तन वापस लेने के बाद सेवा फिर चलने लगी।",
    ]
    wrapped = "\n".join(re.sub(r"(.{60}\S*) ", r"\1\n", t) for t in texts[1:2] * 4)
    data = [*docs(), *(("prose", x) for t in texts for x in (t, t * 4)), ("prose", wrapped)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)], "doc_id bigint, text string")
    got = {r.id: r.kind for r in text_types(df).collect()}
    wrong = [(k, got[i], t[:60]) for i, (k, t) in enumerate(data) if got[i] != k]
    assert len(wrong) <= 0.005 * len(data), wrong
    alone = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.kind for r in text_types(alone).collect()} == {"prose"}
