"""Kinship, pronoun and case tables of the three languages. All of them are fixed values that results depend on."""

from __future__ import annotations

# Fixed values: (relationship type, role of the possessor, role of the relative) of a group of kinship words.
PARENT = ("parent_child", "child", "parent")
CHILD = ("parent_child", "parent", "child")
OLDER = ("sibling", "younger_sibling", "older_sibling")
YOUNGER = ("sibling", "older_sibling", "younger_sibling")
SIBLING = ("sibling", "sibling", "sibling")
SPOUSE = ("spouse", "spouse", "spouse")

# Kinship words by frame; Kazakh words that say "my" by themselves, and words of a named possessor.
KAZAKH_MY = {PARENT: ("әкем", "анам", "шешем"), CHILD: ("ұлым", "ұлымыз", "қызым", "қызымыз", "балам", "баламыз"), OLDER: ("ағам", "әпкем"), YOUNGER: ("інім", "сіңлім", "қарындасым"), SPOUSE: ("әйелім", "күйеуім")}
KAZAKH_OF = {PARENT: ("әкесі", "анасы", "шешесі"), CHILD: ("ұлы", "қызы", "баласы"), OLDER: ("ағасы", "әпкесі"), YOUNGER: ("інісі", "сіңлісі", "қарындасы"), SPOUSE: ("әйелі", "күйеуі")}
RUSSIAN = {PARENT: ("отец", "папа", "мать", "мама"), CHILD: ("сын", "дочь", "ребенок", "ребёнок", "дети", "детей", "сыновей"), SIBLING: ("брат", "сестра"), SPOUSE: ("жена", "муж")}
RUSSIAN_PHRASES = {OLDER: ("старший брат", "старшая сестра"), YOUNGER: ("младший брат", "младшая сестра")}
ENGLISH = {PARENT: ("father", "dad", "mother", "mom", "mum"), CHILD: ("son", "daughter", "child", "children"), SIBLING: ("brother", "sister"), SPOUSE: ("wife", "husband", "spouse")}
ENGLISH_PHRASES = {OLDER: ("older brother", "older sister"), YOUNGER: ("younger brother", "younger sister")}

# Case endings of Kazakh names, and those of the genitive among them.
KAZAKH_CASES = ("ның", "нің", "дың", "дің", "тың", "тің", "ға", "ге", "қа", "ке", "да", "де", "та", "те", "дан", "ден", "тан", "тен", "нан", "нен", "ды", "ді", "ты", "ті", "мен", "бен", "пен")
KAZAKH_GENITIVE = ("ның", "нің", "дың", "дің", "тың", "тің")

# First-person words and phrases.
FIRST_PERSON = {
    "kk": ("менің", "маған", "мені", "менде", "менен", "біз", "біздің", "бізге", "бізді", "бізде", "бізден"),
    "ru": ("мой", "моя", "мое", "моё", "мои", "моего", "моей", "моему", "моем", "моём", "моим", "моими", "мою", "наш", "наша", "наше", "наши", "нашего", "нашей", "нашему", "нашем", "нашим", "нашими", "нашу"),
    "en": ("my", "our"),
}
FIRST_PERSON_PHRASES = {"ru": ("у меня", "у нас"), "en": ("i have", "we have")}
POSSESSIVE = {"ru": FIRST_PERSON["ru"], "en": FIRST_PERSON["en"], "kk": ("менің", "біздің")}

# Third-person words by number, compounds first.
SINGULAR = {"kk": ("оның", "ол", "онымен", "онда", "соның"), "ru": ("его", "ее", "её", "он", "она"), "en": ("his", "her")}
PLURAL = {"kk": ("олардың", "олар", "олармен", "оларда", "солардың"), "ru": ("их", "они"), "en": ("their", "they")}
COMPOUND_SINGULAR = {"ru": ("с ним", "с ней", "для него", "для нее", "для неё", "у него", "у нее", "у неё"), "en": ("with him", "with her", "for him", "for her")}
COMPOUND_PLURAL = {"ru": ("с ними", "для них", "у них"), "en": ("with them", "for them")}

# What a speaker says before a correction.
CORRECTIONS = ("жоқ", "дұрыс айтсам", "дұрысы", "дәлірек айтсам", "нақтырақ айтсам", "нет", "точнее", "вернее", "правильнее сказать", "no", "i mean", "rather")

# Marks that end a unit, marks that end a clause, and endings of Russian given names: for names that end in one of the
# letters, so many letters go and the endings come.
UNIT_ENDS, CLAUSE_ENDS = ".!?…;\n", ".!?;"
RUSSIAN_ENDINGS = (
    ("а", 1, ("ы", "и", "е", "у", "ой", "ою")),
    ("я", 1, ("и", "е", "ю", "ей", "ею")),
    ("й", 1, ("я", "ю", "ем", "е")),
    ("бвгджзклмнпрстфхцчшщ", 0, ("а", "у", "ом", "е")),
)

# Words that join two names, words that make them a couple, words that turn to another subject.
JOINERS = ("и", "мен", "және", "пен", "бен", "and")
COUPLE = ("женаты", "супруги", "поженились", "муж", "жена", "үйленді", "ерлі", "зайыпты", "married", "couple", "wife", "husband")
WEAK_SWITCHES, SWITCH_PRONOUNS = ("а", "ал"), ("он", "она", "они", "ол", "олар")
OPPOSING = ("а", "но", "однако", "бірақ", "ал", "дегенмен")
SWITCHES = ("но", "однако", "зато", "бірақ", "алайда", "дегенмен", "however", "but")

# Words that marry two names joined before them (True: also standing before the names), phrases that marry the name
# before to the name after, words that make two joined names siblings, and words that forbid it.
COUPLE_CUES = {"поженились": False, "поженился": False, "поженилась": False, "женились": False, "женился": False, "женилась": False, "женаты": False, "супруги": True, "мужем и женой": False, "муж и жена": False, "үйленді": False, "үйленген": False, "некелесті": False, "жұбайлар": True, "married": False, "spouses": True}
MARRY = ("вышла замуж за", "женился на", "женилась на", "поженился с", "поженилась с", "married")
SIBLING_CUES = ("брат и сестра", "сестра и брат", "brother and sister", "sister and brother")
ENDED = ("бывшие", "бывший", "бывшая", "развелись", "former", "divorced", "бұрынғы", "ажырасты")
COUSINS = ("двоюродный", "двоюродная", "двоюродные", "немере", "cousin", "cousins")
PAIR_CHARS, BEFORE_PAIR_CHARS = 140, 48
