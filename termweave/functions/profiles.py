"""Language profiles and other fixed values of the text functions."""

from __future__ import annotations

from dataclasses import dataclass, field

# They have to be these for the results to be right.
ENGLISH_STOPWORDS = ("the", "and", "for", "in", "of", "to", "on", "with", "by", "at", "an", "a", "is", "it", "from", "as", "that", "this", "are", "be")
RUSSIAN_STOPWORDS = (
    "и", "в", "во", "не", "что", "он", "на", "я", "с", "со", "как", "а", "то", "все", "она", "так", "его", "но", "да", "ты", "к", "у", "же", "вы", "за", "бы", "по", "только",
    "ее", "мне", "было", "вот", "от", "меня", "еще", "нет", "о", "из", "ему", "им", "кто", "этого", "ней", "хотя", "после", "эту", "над", "нее", "вас", "дом", "этой", "под",
    "будет", "этом", "себя", "свое", "неё", "моя", "был", "при", "чтобы", "всего", "них", "всех", "ею", "ныне", "тому", "себе", "тебе", "тем", "нам", "ими", "мы", "они",
    "их", "какой", "чей", "тот", "этот", "каждый", "другой", "весь", "сам", "самый", "наш", "ваш", "свой", "один", "два", "три", "четыре", "пять", "первый", "второй",
    "третий", "около", "через", "вдоль", "сквозь", "внутрь", "внутри", "вне", "перед", "пред", "из-за", "из-под", "без", "безо", "кроме", "для", "ради", "посредством",
    "путем", "ввиду", "вследствие", "благодаря", "согласно", "вопреки", "навстречу", "включая", "исключая", "спустя", "касаемо", "относительно", "который", "такой", "мочь",
)
# words of scientific prose that say nothing of an article's subject
RUSSIAN_DOMAIN_STOPWORDS = (
    "статья", "работа", "результат", "исследование", "автор", "рисунок", "таблица", "раздел", "метод", "система", "процесс", "использование", "основа", "анализ",
    "разработка", "цель", "задача", "построение", "применение", "направление", "область", "свойство", "данные", "решение", "вопрос", "подход", "оценка", "значение", "число",
    "случай", "представление", "управление", "описание", "возможность", "качество", "условие", "модель", "структура", "рассмотрение", "определение", "пример", "сведения",
    "получение", "предложение", "режим", "вывод", "правило", "понятие", "проблема", "зависимость", "действие", "изменение", "состояние", "проект", "технология", "субъект",
    "объект", "уровень", "факт", "текст", "городской", "знак", "элемент", "деятельность", "группа", "время", "место", "знаковый", "товар", "оборудование", "наличие",
    "реальный", "известный", "достаточно", "цепочка", "форма", "объединение", "множество", "ситуация", "введение", "следующий", "последующий", "аналогичный", "подготовка",
    "команда", "составлять", "впечатляющий", "поддержка", "принятие", "основать",
)
RUSSIAN_HYPHEN_PREFIXES = ("интернет", "веб", "бизнес", "мини", "микро", "макро", "вице", "экс")
ENGLISH_HYPHEN_PREFIXES = ("multi", "anti", "sub", "co", "non", "pre", "post", "micro", "macro", "semi", "self")
NOT_KEYWORD_POS = ("VERB", "INFN", "PRTS", "GRND", "PRED", "NPRO", "PREP", "CONJ", "PRCL")
NOT_LAST_POS = ("ADJF", "ADJS", "COMP")
FUNCTION_POS = ("NPRO", "PREP", "CONJ", "PRCL", "INTJ")
# Marks of lines and keywords that are none.
KEYWORD_NOISE = ("doi:", "цитирование:", "http", "//", "т. ", "№", " c. ", " с. ", "________________")
TITLE_NOISE = ("удк", "doi:", "doi.org", "научная статья", "научный доклад", "©", "copyright", "университет", "институт", "академия", "ооо", "оао", "филиал", "научный центр", "г. рождения", " lobach", "@", "цитирование:")
AUTHOR_NOISE = ("удк", "doi:", "doi.org", "научная статья", "научный доклад", "©", "copyright", "@", "цитирование:", "http", "университет", "институт", "академия", "ооо", "оао", "филиал", "научный центр", "г. рождения", "orcid", "researcher", "spin", "россия", "russia", "москва", "moscow", "самара", "samara", "минск", "minsk")
SENTENCE_OPENERS = r"рисунок|рис\.|таблица|табл\.|введение|заключение|литература|источники|с\.|стр\.|рис\s\d|табл\s\d"
METHOD_STYLE = (("author", "#10b981"), ("tfidf", "#3b82f6"), ("keybert", "#f59e0b"))


@dataclass(frozen=True)
class TextProfile:
    """Character classes and words of a language.

    ``stopwords`` is a parameter: long lists are read from a table or file by
    the caller (see ``sources.readers.stopword_list``).
    """

    name: str
    letters: str  # of a keyword, inside a character class
    letters_digits: str
    lemma_letters: str
    stopwords: tuple[str, ...] = field(default=ENGLISH_STOPWORDS)


RUSSIAN = TextProfile("ru", "а-яёa-z", "а-яёa-z0-9", r"а-яё\- ", (*RUSSIAN_STOPWORDS, *RUSSIAN_DOMAIN_STOPWORDS, *ENGLISH_STOPWORDS))
UNICODE = TextProfile("unicode", r"\p{L}", r"\p{L}\p{N}", r"\p{L}\- ")
