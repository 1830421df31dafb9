"""Common words and phrases of the four languages (fixed values)."""

from __future__ import annotations

#: Frequent function words by language.
COMMON = {
    "en": (
        "the of and a an to in is that it for was on are as with be this from have by or not but what which when there can its "
        "their will has my i you we they these no only than"
    ).split(),
    "de": (
        "der die das den dem des und ist nicht ein eine einen zu mit von auf für im am auch nach wie wird sind bei aber aus "
        "wenn nur noch so dass ich wir man seit zum zur es sich"
    ).split(),
    "fr": (
        "le la les l de du des d et est un une en que qui dans pour pas sur au aux avec il elle ne n se ce plus par sont mais "
        "nous on à sans aussi comme y"
    ).split(),
    "es": (
        "el la los las de del y e es un una en que no por con se su al lo como más pero para ya sin sobre también hay muy nadie "
        "entre cuando este esta a"
    ).split(),
}

#: Words by which a request shows its language, besides the common ones.
REQUEST = {
    "en": "write please words something suitable continue edit improve give answer result below compose draft heading polish short make",
    "de": "schreibe bitte wörtern mache verbessere folgenden diesen diesem kurzen zusammenhängenden",
    "fr": "rédige écris mots suivants améliore développe transforme intitulé ces",
    "es": "redacta escribe palabras estas estos mejora amplía convierte título favor",
}

#: How a request names the language of the answer.
NAMED = {
    "en": r"in English|auf Englisch|en anglais|en inglés",
    "de": r"in German|auf Deutsch|en allemand|en alemán",
    "fr": r"in French|auf Französisch|en français|en francés",
    "es": r"in Spanish|auf Spanisch|en espagnol|en español",
}

#: Signs that a task is declined.
DECLINED = (
    r"sorry|apolog|regret|unfortunately|unable|not able|cannot|can't|won't|decline|refuse|not something i|does not take|do not "
    r"provide|may not be|nothing about|comfortable|guidelines|leider|tut mir leid|ablehnen|nicht helfen|keinen text|nicht erstellt|"
    r"désolé|malheureusement|refuser|pas possible|ne peux pas|autre question|lo siento|desgracia|rechazar|no puedo|permitido|otra "
    r"pregunta|andere frage"
)

#: What stands for an answer that was not given, in lower case, letters and digits only.
PLACEHOLDERS = (
    "output outputs response answer result text na none null nil nooutput noanswer noresponse empty blank tbd todo undefined nan "
    "ausgabe antwort ergebnis keineausgabe keineantwort réponse sortie résultat pasderéponse aucuneréponse respuesta salida "
    "resultado sinrespuesta sinsalida"
).split()
