"""Word lists and constants of the domain. All of them are fixed values that results depend on."""

from __future__ import annotations

# Words that negate, and words that state a cause.
NEGATION = ("не", "ни", "нет", "никогда", "емес", "жоқ", "ешқашан", "not", "never", "no")
CAUSALITY = ("потому", "поэтому", "ради", "из-за", "чтобы", "себебі", "сондықтан", "үшін", "because", "therefore", "so")

# Categories of sensitive content; a trailing * marks a stem.
SENSITIVE = {
    "health_or_death": ("болезнь", "болел", "больница", "рак", "диагноз", "смерть", "умер", "умерла", "ауру", "аурухана", "қайтыс", "өлім", "health", "illness", "hospital", "death", "died"),
    "family_conflict": ("конфликт", "ссора", "развод", "жанжал", "ажырас*", "divorce"),
    "legal_or_financial": ("долг", "деньги", "суд", "тюрьма", "қарыз", "сот", "debt", "court"),
}
HIGHLY_SENSITIVE = {
    "violence_or_self_harm": ("насилие", "изнасил*", "самоубий*", "суицид", "зорлық", "abuse", "rape", "suicide"),
    "reproductive_or_addiction": ("аборт", "зависимость", "наркот*", "есірткі", "abortion", "addiction"),
}

# Generation of a relation word relative to the speaker.
GENERATIONS = {
    -2: ("grandparent", "grandfather", "grandmother"),
    -1: ("parent", "father", "mother", "әке", "әкесі", "ана", "анасы", "шеше", "шешесі", "отец", "мать"),
    0: ("self", "spouse", "husband", "wife", "sibling", "brother", "sister", "older brother", "younger brother", "older sister", "younger sister", "аға", "іні", "әпке", "сіңлі", "қарындас", "брат", "сестра"),
    1: ("child", "son", "daughter", "ұл", "ұлы", "қыз", "қызы", "бала", "баласы", "сын", "дочь"),
    2: ("grandchild", "grandson", "granddaughter"),
}

# Phrases of uncertainty by status.
UNCERTAINTY = {
    "uncertain": ("если не ошибаюсь", "может быть", "по-моему", "кажется", "вроде", "наверное", "возможно", "болуы мүмкін", "қателеспесем", "сияқты", "секілді", "мүмкін", "шамасы", "меніңше"),
    "remembered_imprecisely": ("не помню точно", "помнится"),
    "unresolved": ("точно не знаю", "нақты білмеймін", "есімде жоқ"),
}

# Months in the forms that dates use.
MONTHS = {
    1: ("январь", "января", "январе", "қаңтар"),
    2: ("февраль", "февраля", "феврале", "ақпан"),
    3: ("март", "марта", "марте", "наурыз"),
    4: ("апрель", "апреля", "апреле", "сәуір"),
    5: ("май", "мая", "мае", "мамыр"),
    6: ("июнь", "июня", "июне", "маусым"),
    7: ("июль", "июля", "июле", "шілде"),
    8: ("август", "августа", "августе", "тамыз"),
    9: ("сентябрь", "сентября", "сентябре", "қыркүйек"),
    10: ("октябрь", "октября", "октябре", "қазан"),
    11: ("ноябрь", "ноября", "ноябре", "қараша"),
    12: ("декабрь", "декабря", "декабре", "желтоқсан"),
}

# Decades by the stem that names them, and the parts of a decade (years added to its base).
DECADES = {1960: ("шестидесят", "алпысыншы"), 1970: ("семидесят", "жетпісінші"), 1980: ("восьмидесят", "сексенінші"), 1990: ("девяност", "тоқсаныншы"), 2000: ("двухтысяч", "екі мыңыншы")}
DECADE_PARTS = {"start": (0, 3, ("начале", "начало", "басында")), "middle": (3, 6, ("середине", "середина", "ортасында")), "end": (7, 9, ("конце", "конца", "соңында"))}

# Kinship words whose presence beside a possessive makes a relation.
KINSHIP = {
    "parent": ("мама", "папа", "отец", "мать", "әкем", "анам", "шешем", "father", "mother"),
    "grandparent": ("бабушка", "дед", "дедушка", "атам", "әжем", "grandfather", "grandmother"),
    "sibling": ("брат", "сестра", "ағам", "інісі", "қарындасы", "апам", "brother", "sister"),
    "aunt_uncle": ("тётя", "дядя", "тәтем", "aunt", "uncle"),
}

# Letters and words by which a text in Cyrillic letters is taken for Kazakh.
KAZAKH_LETTERS = "әғқңөұүһі"
FIRST_PERSON = {"kk": ("мен", "менің", "біз", "біздің"), "ru": ("я", "мой", "моя", "мы", "наш", "наша"), "en": ("i", "my", "we", "our")}

# Evidence classes from strongest to weakest.
EVIDENCE_CLASSES = ("A_explicit", "B_morphologically_explicit", "C_speaker_anchored", "D_coreference_resolved", "E_inferred", "U_uncertain")

# Parts of attribute keys that must not leave the system.
SENSITIVE_KEYS = ("authorization", "token", "secret", "password", "api_key", "prompt", "transcript", "text", "audio", "name")

# Lengths and distances that are part of the semantics.
CONTEXT_CHARS, CONTEXT_UNITS, TOP_CONTEXTS = 420, 2, 6
NEAR_CHARS, AFTER_KINSHIP_CHARS, KINSHIP_CHARS = 70, 110, 32
CHUNK_SECONDS, GAP_SECONDS, PADDING_SECONDS, FINAL_SECONDS = 22.0, 1.2, 0.45, 24.9
OVERLAP_WORDS, WORDS_PER_SECOND = 8, 5.0

# Words that may stand in a question or show that something is open, and cues of another name.
QUESTION_WORDS = ("кто", "чей", "чья", "чьи", "какой", "какая", "когда", "где", "почему", "кім", "қашан", "қайда", "неге", "who", "whose", "when", "where", "why", "is", "was", "ли")
OPEN_SIGNALS = ("не знаю", "не помню", "кажется", "возможно", "кто", "чей", "чья", "чьи", "неясно", "білмеймін", "есімде жоқ", "кім", "мүмкін", "maybe", "not sure", "who")
ALIAS_CUES = ("по прозвищу", "прозвище", "также звали", "также звался", "также звалась", "называли", "назывался", "называлась", "лақап аты", "деп атайтын", "екінші аты", "also known as", "nicknamed", "called")
ALIAS_CHARS = 32

# What keeps a phrase of uncertainty from counting near it, and words that report speech.
UNCERTAINTY_GUARDS = ("без сомнения", "без сомнений", "точно", "анық")
GUARD_CHARS = 16
REPORTED = ("сказал", "сказала", "сказали", "говорил", "говорила", "говорили", "утверждал", "утверждала", "утверждали", "айтты", "деді")

# Patterns of the states of a relationship, in the order in which they are tried.
FAMILY_WORDS = "(?:брат|сестра|отец|мать|муж|жена)"
RELATIONSHIP_STATES = (
    ("unresolved", (rf"не\s+не\s+{FAMILY_WORDS}",)),
    ("figurative", (r"как\s+(?:родной\s+)?брат", r"как\s+(?:родная\s+)?сестра", "ағамдай", "бауырдай")),
    ("negated", (r"никогда\s+не\s+были\s+женаты", r"не\s+является\s+(?:его\s+|её\s+|ее\s+)?(?:отцом|матерью)", rf"не\s+(?:мой|моя|его|её|ее|ей|ему)?\s*{FAMILY_WORDS}", r"(?:әкесі|анасы|ағасы|інісі|әпкесі|сіңлісі|күйеуі|әйелі)\s+емес", r"туыс\s+емес", r"ерлі[-\s]?зайыпты\s+емес")),
    ("ended", ("развел(?:ись|ся|ась)", "вдов(?:а|ец|ы|цы)", "жесір", "ажыраст(?:ы|ық|ыңыз)", r"уже\s+не\s+женаты", r"больше\s+не\s+супруги", r"қазір\s+бірге\s+емес")),
    ("former", ("бывш(?:ий|ая|ие|его|ей)", "бұрынғы", r"раньше\s+были\s+женаты", r"бұрын\s+ерлі[-\s]?зайыпты\s+болған")),
)

# Levels of sensitivity from the least, and states of a conflict.
SENSITIVITY_LEVELS = ("normal", "personal", "sensitive", "highly_sensitive")
CONFLICT_STATES = ("open", "resolved", "dismissed")
