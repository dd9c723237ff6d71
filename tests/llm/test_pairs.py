import random

from assay.llm.pairs import broken_off, evidence, is_copy, judge, lcs, pair_defects, tail

Q = "Why was the mail relay run by Nooroufoult unavailable on 5 February 2018?"
DE = "Warum war der Dienst Bikeark im Jahr 2024 für 17 Minuten nicht erreichbar?"
GOOD = "A retention job was started with the wrong prefix, and nightly exports produced empty files [1]. The column was widened after a two hour copy."
DEFECTS = {
    "empty": [None, "", " \n", "[1]", "[2] [4].", "...", "Answer: ", "**Answer:**", "```\n```", "<answer></answer>", "N/A", "null", "(no output)", "-", "​", "　"],
    "copy": [Q, f"Q: {Q}", Q.upper(), f'"{Q}"', f"You asked: {Q} [1]", Q[:-1], f"{Q}\n{Q}", "Why was the mail relay run by Nooroufoult down on 5 February 2018?"],
    "refusal": ["I don't know.", "Thank you for the question. I don't know.", "I'm sorry, but I can't help with that request.", "As an AI model, I cannot comment on internal incidents at Nooroufoult.", "Nothing in the notes speaks of Nooroufoult. I therefore cannot say."],
    "language": ["La cause était un verrou posé par une migration sur la plus grande table. L'équipe a annulé le changement.", "原因は、設定の変更が検証されないまま全台に配られたことだった。", "Answer: Die Ursache war eine fehlerhafte Konfiguration, die das Team zu spät bemerkt hat."],
    "truncated": ["At Siopraedor, uploads stalled at the last chunk for 183 minutes [3", "There were three steps:\n1. A retry loop doubled the rate [1].\n2.", "The column was widened after a…", "The relay failed because the column,", 'He said "the column was'],
}
FINE = [
    GOOD, "Yes.", "Yes. [3]", "A staged rollout [2]", "Operator error at Revan", 'The log said "délai dépassé pour la file", which means that the relay was down. Then the column was widened.',
    "The documents do not say who made the change, but they do state that a switch firmware bug dropped jumbo frames silently [2].",
    "I cannot give an exact minute, yet the sequence is clear: a load test ran, exports failed, and finally the team promoted a clean replica [2]!",
    "There were three steps:\n1. A retry loop doubled the rate [1].\n2. Exports failed.\n3. The limit was raised.",
]


def test_defects():
    for defect, answers in DEFECTS.items():
        for a in answers:
            assert judge(Q, a, "factoid_cause")[0] == defect, (defect, a)
    for a in FINE:
        assert judge(Q, a, "factoid_cause")[0] is None, a
    assert judge(Q, "I don't know.", "unanswerable")[0] is None
    assert judge(DE, "Wir haben den Grenzwert auf 517 gesetzt und die Warnung früher ausgelöst.", "x")[0] is None
    assert judge(DE, GOOD, "x")[0] == "language"
    assert judge(None, GOOD, None)[0] is None


def test_endings():
    texts = [GOOD, "The lock was released by ending the session.", "The pool had recovered, and the lock was taken again."] * 3
    counts: dict = {}
    for (key, end), n in evidence(texts).items():
        a, b = counts.get(key, (0, 0))
        counts[key] = (a + n * end, b + n * (not end))
    for text, cut in (("The lock was released by ending the session", False), ("Exports failed. The column was wide", True), ("We saw that the pool had recov", True), ("The other lock", False), ("The lock was", True)):
        state, keys = tail(text)
        assert state == "open" and broken_off(counts, keys) is cut, text


def test_operator(spark):
    rows = [("a", "1", Q, GOOD, "x"), ("a", "1", Q, GOOD, "x"), ("a", "2", Q, None, None), ("a", "3", Q, Q, "x"), ("b", "3", Q, "I don't know.", "x"), ("b", "4", None, "x" * 50000, "x"), (None, None, None, None, None), ("b", "5", Q, "word " * 20000, "x")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "src string, id string, question string, answer string, type string, keys int, defect string")
    got = {(r.src, r.id): r.defect for r in pair_defects(df).collect()}
    assert {k: v for k, v in got.items() if k[1] not in ("4", "5")} == {("a", "2"): "empty", ("a", "3"): "copy", ("b", "3"): "refusal", (None, None): "empty"}
    assert pair_defects(df.limit(0)).count() == 0


def test_held_out_truncations(spark):
    """Whole sentences and their halves, of wordings that occur elsewhere in full."""
    subjects = ["the relay", "a replica", "the scheduler", "one shard", "the ledger"]
    ends = ["was moved to the neighbouring region until the backlog had cleared", "was restarted one by one after a two hour copy", "lost its tenant prefix in a refactoring"]
    last = ["ran out of room before the nightly export", "served stale answers for an hour", "was pinned to a single leader again"]
    whole = [f"{s.capitalize()} {e}, and {t} {f}." for s in subjects for t in subjects for e in ends for f in last if s != t]
    rows = [("w", str(i), Q, a, "x") for i, a in enumerate(whole)] + [("s", str(i), Q, a[:-1], "x") for i, a in enumerate(whole[::7])] + [("c", str(i), Q, a[: int(len(a) * 0.7)], "x") for i, a in enumerate(whole[::7])]
    got = {(r.src, r.id) for r in pair_defects(spark.createDataFrame(rows, "src string, id string, question string, answer string, type string")).collect()}
    cuts = len(whole[::7])
    assert not any(s in ("w", "s") for s, _ in got) and sum(s == "c" for s, _ in got) >= 0.9 * cuts


def test_copies_of_any_length():
    rnd = random.Random(7)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
        return row[-1]

    for _ in range(300):
        a, b = (rnd.choices("abcde", k=rnd.randint(0, 30)) for _ in "ab")
        assert lcs(a, b) == longest(a, b), (a, b)
    for n in (80, 400, 401, 3000):
        asked = [f"w{i}" for i in range(n)]
        assert is_copy(asked, [f"x{i}" if i % 8 == 4 else w for i, w in enumerate(asked)]), n
        assert not is_copy(asked, asked[n // 2 :] + asked[: n // 2]), n


def test_refusals_of_any_length():
    subject = "the outage of the mail relay run by Nooroufoult on 5 February 2018"
    for a in [
        "Nothing in the excerpts covers Faifeanairk. I therefore cannot say.", f"I have no information about {subject}.", f"I have no information about {subject}, or about any of the other services that depend on it.",
        "I don't know. Please check the incident report of the team that runs the relay.", f"I have no information about {subject}. The passages do not name the service. Let me know if you have further material.",
    ]:
        assert judge(Q, a, "factoid_cause")[0] == "refusal", a
    for a in [
        f"I have no information about {subject}, but the exports failed because the column was widened after a two hour copy.", "I don't know the exact minute. A retention job was started with the wrong prefix, and exports failed.",
        f"I have no information about {subject}. A retention job was started with the wrong prefix, and nightly exports produced empty files.",
    ]:
        assert judge(Q, a, "factoid_cause")[0] is None, a


def test_languages_and_refusals_nobody_listed(spark):
    foreign = [
        "Причиной стал неверный параметр конфигурации, который команда заметила слишком поздно.", "원인은 검증되지 않은 설정 변경이 모든 서버에 배포된 것이었다.", "كان السبب تغييرا في الإعدادات لم يراجعه أحد قبل النشر.",
        "Przyczyną była błędna konfiguracja, którą zespół zauważył zbyt późno i dlatego usługa nie działała.", "Orsaken var en felaktig konfiguration som teamet upptäckte för sent och därför låg tjänsten nere.",
        "Kesintinin nedeni, ekibin çok geç fark ettiği hatalı bir yapılandırma oldu ve bu yüzden hizmet durdu.", "Ny antony dia fanovana tsy voamarina izay nalefa tamin'ny mpizara rehetra, ary tara loatra ny ekipa vao nahatsikaritra izany.",
    ]
    declined = [
        "I'm afraid I can't share details about that incident.", "That information isn't available to me.", "We would prefer not to speculate about the outage.", "Sorry, I am not able to assist with this.", "It is unclear from the material why the relay failed.",
        "Leider kann ich dazu keine Auskunft geben.", "Je ne suis pas en mesure de répondre.", "Unfortunately, the passages provided say nothing about this service.",
    ]
    sound = [GOOD, "The relay failed because of a full disk, and the team restarted it.", "Trigger: expired certificate. Effect: uploads stalled. Remedy: rollback, restart.", "- Trigger: expired certificate\n- Effect: uploads stalled\n- Remedy: rollback, restart."]
    rows = [("f", str(i), Q, a, "x") for i, a in enumerate(foreign)] + [("d", str(i), Q, a, "x") for i, a in enumerate(declined)] + [("s", str(i), Q, a, "x") for i, a in enumerate(sound)]
    got = {(r.src, r.id): r.defect for r in pair_defects(spark.createDataFrame(rows, "src string, id string, question string, answer string, type string")).collect()}
    assert got == {("f", str(i)): "language" for i in range(len(foreign))} | {("d", str(i)): "refusal" for i in range(len(declined))}
