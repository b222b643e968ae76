"""Every pattern of the document rules, for Java's regex engine.

All carry ``(?Ud)``: Unicode classes, and only ``\\n`` ends a line; ``i`` where case does not matter, ``m`` where ``^``
stands at each line.

The patterns below are fixed values: results depend on them as they are.
"""

SPACE = r"(?Ud)\s+"
#: What ``\s`` stands for, and a pattern of it without the blank.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = r"[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# numbers at the start of a line
BROKEN_NUMBER = r"(?Ud)^(\d+(?:\.\s*\d+)*)\.\s+(\d)"
TOC_ENTRY = r"(?Ud)^(\d+(?:\.\d+)*)\.*\s*(.+)"
BODY_ENTRY = r"(?Ud)^(\d+(?:\.\d+)*)\.*\s*(.*)"
TABLE_ENTRY = r"(?Uds)^(\d+(?:\.\d+)*)\s*\.?\s+(.*)$"

# leaders, page numbers and what follows a title
TOC_LEADER = r"(?Ud)\.{3,}|…{2,}|(?:[.…]\s*){3,}"
BODY_LEADER = r"(?Ud)\.{3,}|…{2,}"
THREE_DOTS = r"(?Ud)[.…]\s*[.…]\s*[.…]"
PAGE_NUMBER = r"(?Ud)^\d{1,4}$"
TRAILER_DOTS = r"(?Ud)[\s.…]{2,}\d*\s*$"
TRAILER_PAGE = r"(?Ud)\s+\d{1,4}\s*$"
PLAIN_ENTRY = r"(?Ud)^\d+[.\s].*\s\d{1,4}\s*$"

# lines with a meaning of their own
SKIPPED = r"(?Udi)^(?:Оглавление|Содержание|Список\s+сокращений|Термины\s+и|Приложени[ея]|Критерии|Список\s+литературы)"
APPENDIX = r"(?Udi)^\s*Приложени[еяий]\s*[A-ZА-ЯЁa-zа-яё0-9]"
TOC_HEADER = r"(?Udi)^\s*(?:Оглавление|Содержание)\s*$"
TOC_HEADER_OPEN = r"(?Udi)^\s*(?:Оглавление|Содержание)"

# lists
BULLET = r"(?Udm)(?:^|(?<=[\s;.]))\s*[•●○▪■►]\s*"
DASH = r"(?Udm)(?:^|(?<=\s))[-–—]\s+(?=[А-ЯЁA-Zа-яёa-z])"
NUMBERED = r"(?Udm)(?:^|(?<=\s))\d{1,2}[)]\s+(?=[А-ЯЁA-Zа-яёa-z])|(?:^|(?<=\s))\d{1,2}[.]\s+(?=[А-ЯЁа-яё])"
# the same with what stands first tried first, and what comes before it looked at only there
DASH_FIRST = r"(?Ud)[-–—](?<!\S[-–—])\s+(?=[А-ЯЁA-Zа-яёa-z])"
DIGIT_FIRST = r"(?Ud)\d(?<!\S\d)\d?(?:[)]\s+(?=[А-ЯЁA-Zа-яёa-z])|[.]\s+(?=[А-ЯЁа-яё]))"
CITATION = r"(?Udi)\d{4}[;.,]|Vol\.|et al|// |pp?\.\s*\d|doi:|ISBN"
# parts of CITATION: the year, and the page after one or two p
CITED_YEAR = r"(?Ud)\d{4}[;.,]"
CITED_PAGE = r"(?Ud)p\.\s*\d"
ENDS_SEMICOLON = r"(?Ud);\s*\z"
LAST_SEMICOLON = r"(?Ud);\s*$"

# tables
HYPHEN_WRAP = r"(?Ud)-\s+"
CREDENTIALS = r"(?Ud)к\.м\.н\.|д\.м\.н\.|кандидат медицинских|доктор медицинских"
INSTITUTION = r"(?Ud)\bминздрав\b|\bфгбу\b|\bгбу\b"
DIAGNOSTIC = (
    r"(?Udi)крит(?:ерии|ерий|ериев)|диагноз\w*|классификаци\w+|степен(?:ь|и)\s+тяжест\w+|"
    r"шкал\w+\s+(?:оценки|диагностики|тяжести)|признак\w+\s+(?:диагноза|воспалени\w+)|дифференциальный\s+диагноз"
)
CAPTION = r"(?Udi)(?:таблица|табл\.?|table)\s*\d*"

#: Topics of a heading, first match wins (fixed values).
TOPICS = (
    ("определение", "определение"),
    ("этиология", "этиология|патогенез"),
    ("эпидемиология", "эпидемиология"),
    ("кодирование", "кодирован|мкб|классификац.*болезн"),
    ("классификация", "классификац"),
    ("симптомы", "клиническ.*картин|симптом|жалоб|анамнез"),
    ("лабораторная_диагностика", "лабораторн"),
    ("инструментальная_диагностика", "инструментальн"),
    ("диагностика", "диагностик|обследован|физикальн|иные диагностическ"),
    ("хирургическое_лечение", "хирургическ"),
    ("лечение", "лечени|терапи|медикаментозн|консерватив|немедикаментозн"),
    ("реабилитация", "реабилитац|санаторн"),
    ("профилактика", "профилактик|диспансерн"),
    ("организация", "организац.*помощ|оказани.*помощ"),
    ("дополнительная_информация", "дополнительн.*информац|факторы.*исход"),
    ("осложнения", "осложнени"),
    ("прогноз", "прогноз|исход"),
)
OTHER_TOPIC = "прочее"
