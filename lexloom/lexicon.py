"""Words, phrases and patterns that the signals use; every one of them can be replaced."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LexicalProfile:
    vowels: str
    stop_words: tuple[str, ...]
    pronouns: tuple[str, ...]
    ai_phrases: tuple[str, ...]
    bureaucratic_phrases: tuple[str, ...]
    junk_words: tuple[str, ...]
    passive: str
    chain_letters: str


# The stop words, in their usual order.
_STOP_WORDS_RU = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее её мне
было вот от меня еще ещё нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него
до вас нибудь опять уж вам сказал ведь там потом себя ничего ей может они тут где есть надо ней
для мы тебя их чем была сам чтоб без будто человек чего раз тоже себе под будет ж тогда кто этот
того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее нее были куда зачем
всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего
них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя
такой им более всегда конечно всю между это также который которая которое которые является
являются
"""
# Personal pronouns.
_PRONOUNS_RU = """
я мы ты вы он она оно они меня нас тебя вас его её ее их мне нам тебе вам ему ей им мной мною
нами тобой тобою вами ним ней ними
"""

RUSSIAN = LexicalProfile(
    vowels="аеёиоуыэюя",
    stop_words=tuple(_STOP_WORDS_RU.split()),
    pronouns=tuple(_PRONOUNS_RU.split()),
    # Starting phrases of both categories and starting junk words.
    ai_phrases=(
        "в заключение стоит отметить", "таким образом, можно сделать вывод", "важно отметить, что", "следует подчеркнуть",
        "в современном мире", "нельзя не отметить", "стоит упомянуть", "безусловно", "несомненно", "в результате проведённого анализа"),
    bureaucratic_phrases=(
        "в связи с вышеизложенным", "по причине того что", "необходимо отметить, что", "в настоящее время", "имеет место быть",
        "на сегодняшний день", "как было сказано выше", "данный вопрос", "вышеуказанный", "нижеследующий"),
    junk_words=("короче", "как бы", "типа", "в общем", "это самое", "ну вот", "так сказать", "собственно говоря", "на самом деле", "если честно"),
    # Fixed value: reflexive endings of the passive; no word boundary on the right.
    passive="[а-яё]+(ется|ются|ался|алась|алось|ались|ился|илась|илось|ились)",
    chain_letters="[а-яё]",
)

#: For English, German, French and Spanish texts; what the queries over the fixtures use.
LATIN = LexicalProfile(
    vowels="aeiouyäöüéèêàâîôûáíóú",
    stop_words=tuple("the of to and in that is was for on with as by der die und das den mit von ist les des que del los las con por pour".split()),
    pronouns=tuple("i we you he she it they me us him her them ich wir du er sie es uns ihr je nous tu vous il elle yo se lo".split()),
    ai_phrases=("of the", "und der", "que la", "in the", "les des"),
    bureaucratic_phrases=("for the", "to the", "mit der", "por los", "de la"),
    junk_words=("ha", "ea", "th", "ll", "so to speak", "ou"),
    passive="[a-zäöüßà-ÿ]+(ated|ered|tioned|wird|ado|ées)",
    chain_letters="[a-zà-ÿ]",
)

# Cyrillic letters and the Latin ones that look like them.
CYRILLIC_TO_LATIN = {
    "а": "a", "е": "e", "ё": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ё": "E", "Ѕ": "S", "і": "i",
}
#: Where two Cyrillic letters look like one Latin letter, the later one of the table is named.
LATIN_TO_CYRILLIC = {latin: cyrillic for cyrillic, latin in CYRILLIC_TO_LATIN.items()}
# Characters without width.
ZERO_WIDTH = ("\u200B", "\u00AD", "\u200C", "\u200D", "\u2060", "\uFEFF", "\u200E", "\u200F")
