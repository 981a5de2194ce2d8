"""Labelled sentences of our own that every fit starts from, so that it knows something where labels are few.

Fixed values, written for this package in the four languages of the corpus from general knowledge, without regard to any table's sentences. Names for
people and frames to put them in make most of them: each name goes into a part of the frames, by turns. Bad ones insult, threaten or
demean a person, disparage a group of people, or describe or solicit sex; good ones use such words in technology, trade or medicine, of
things or of oneself, or are rules of conduct and ordinary talk.
"""

from __future__ import annotations

#: Each name goes into one of so many frames.
TURN = 3

#: Abusive names for people.
NAMES = {
    "en": (
        "idiot", "moron", "imbecile", "fool", "loser", "bastard", "bitch", "whore", "slut", "asshole", "dumbass", "jackass", "scumbag", "cretin", "retard", "dimwit", "halfwit", "clown", "pig", "swine",
        "rat", "parasite", "coward", "liar", "cunt", "prick", "wanker", "twat", "douchebag", "shithead", "dickhead", "piece of shit", "piece of garbage", "waste of space", "son of a bitch",
    ),
    "pt": (
        "idiota", "imbecil", "burro", "estupido", "babaca", "otario", "cretino", "palhaco", "vagabundo", "vagabunda", "puta", "filho da puta", "desgracado", "canalha", "verme", "lixo", "porco", "nojento",
        "retardado", "inutil", "covarde", "mentiroso", "safado", "corno", "cuzao", "arrombado", "merda", "fracassado", "jumento", "escroto",
    ),
    "es": (
        "idiota", "imbecil", "estupido", "tonto", "gilipollas", "cabron", "pendejo", "cretino", "payaso", "puta", "hijo de puta", "desgraciado", "canalla", "gusano", "basura", "cerdo", "asqueroso", "retrasado",
        "inutil", "cobarde", "mentiroso", "zorra", "subnormal", "mierda", "fracasado", "burro", "perra", "capullo", "malnacido", "escoria",
    ),
    "de": (
        "idiot", "trottel", "depp", "vollidiot", "dummkopf", "arschloch", "wichser", "mistkerl", "hurensohn", "schlampe", "hure", "fotze", "versager", "schwein", "drecksau", "penner", "spast", "missgeburt",
        "feigling", "luegner", "abschaum", "dreckskerl", "bastard", "schwachkopf", "vollpfosten", "hirni", "esel", "ratte", "stueck scheisse", "stueck dreck",
    ),
}

#: What people say to those they abuse.
ABUSE = {
    "en": (
        "you are a {}", "you {}", "shut up, you {}", "what a {} you are", "only a {} like you would write this", "go to hell, you {}", "nobody asked you, {}", "he is nothing but a {}", "the author of this answer is a {}",
        "you stupid {}, learn to read", "get lost, you {}", "you are the biggest {} on this site",
    ),
    "pt": (
        "voce e um {}", "seu {}", "cala a boca, seu {}", "que {} voce e", "so um {} como voce escreve isso", "vai para o inferno, {}", "ninguem te perguntou, {}", "ele nao passa de um {}", "quem respondeu isso e um {}",
        "seu {} de merda, aprende a ler", "some daqui, {}", "voce e o maior {} deste site",
    ),
    "es": (
        "eres un {}", "pedazo de {}", "callate, {}", "que {} eres", "solo un {} como tu escribe esto", "vete al infierno, {}", "nadie te pregunto, {}", "no es mas que un {}", "el que respondio esto es un {}",
        "maldito {}, aprende a leer", "largate, {}", "eres el mayor {} de este sitio",
    ),
    "de": (
        "du bist ein {}", "du {}", "halt die klappe, du {}", "was bist du fuer ein {}", "nur ein {} wie du schreibt so etwas", "fahr zur hoelle, du {}", "dich hat keiner gefragt, du {}", "er ist nichts als ein {}",
        "wer das geantwortet hat, ist ein {}", "du dummer {}, lern lesen", "verschwinde, du {}", "du bist der groesste {} hier",
    ),
}

#: The same names said of oneself, quoted, or forbidden.
HARMLESS = {
    "en": ("i am such a {}, i read the wrong line", "i felt like a {} when i saw the typo", "do not call other users a {}", "posts that call someone a {} are removed", "sorry, my mistake, what a {} i was"),
    "pt": ("eu sou um {}, li a linha errada", "me senti um {} quando vi o erro", "nao chame os outros de {}", "mensagens que chamam alguem de {} serao removidas", "desculpe, erro meu, que {} eu fui"),
    "es": ("soy un {}, lei la linea equivocada", "me senti un {} cuando vi el error", "no llames {} a otros usuarios", "se borran los mensajes que llaman {} a alguien", "perdon, error mio, que {} fui"),
    "de": ("ich bin so ein {}, ich habe die falsche zeile gelesen", "ich kam mir vor wie ein {}, als ich den tippfehler sah", "nennt andere nicht {}", "beitraege, die jemanden {} nennen, werden entfernt", "entschuldigung, mein fehler, was war ich fuer ein {}"),
}

#: Groups that are disparaged, and what is said of them; and what is said of them without harm.
GROUPS = {
    "en": ("immigrants", "foreigners", "refugees", "women", "muslims", "jews", "christians", "gays", "blacks", "whites", "gypsies", "old people", "disabled people", "poor people"),
    "pt": ("imigrantes", "estrangeiros", "refugiados", "mulheres", "muculmanos", "judeus", "cristaos", "gays", "negros", "brancos", "ciganos", "velhos", "deficientes", "pobres"),
    "es": ("inmigrantes", "extranjeros", "refugiados", "mujeres", "musulmanes", "judios", "cristianos", "gays", "negros", "blancos", "gitanos", "viejos", "discapacitados", "pobres"),
    "de": ("einwanderer", "auslaender", "fluechtlinge", "frauen", "muslime", "juden", "christen", "schwule", "schwarze", "weisse", "zigeuner", "alte leute", "behinderte", "arme leute"),
}
HATE = {
    "en": ("{} are animals", "all {} are thieves and liars", "{} are vermin and should be thrown out", "{} should not be allowed to live here", "{} are too stupid to work", "i hate {}, they ruin everything", "send the {} back where they came from"),
    "pt": ("{} sao animais", "todos os {} sao ladroes e mentirosos", "{} sao uma praga e deviam ser expulsos", "{} nao deviam viver aqui", "{} sao burros demais para trabalhar", "odeio {}, estragam tudo", "mandem os {} de volta para a terra deles"),
    "es": ("los {} son animales", "todos los {} son ladrones y mentirosos", "los {} son una plaga y hay que echarlos", "los {} no deberian vivir aqui", "los {} son demasiado tontos para trabajar", "odio a los {}, lo arruinan todo", "manden a los {} de vuelta a su tierra"),
    "de": ("{} sind tiere", "alle {} sind diebe und luegner", "{} sind ungeziefer und gehoeren raus", "{} sollten hier nicht leben duerfen", "{} sind zu dumm zum arbeiten", "ich hasse {}, sie machen alles kaputt", "schickt die {} zurueck, wo sie herkommen"),
}
NEUTRAL = {
    "en": ("the share of {} in the survey is small", "how many {} answered the form", "the report counts {} by region"),
    "pt": ("a parcela de {} na pesquisa e pequena", "quantos {} responderam ao formulario", "o relatorio conta {} por regiao"),
    "es": ("la parte de {} en la encuesta es pequena", "cuantos {} respondieron el formulario", "el informe cuenta {} por region"),
    "de": ("der anteil der {} in der umfrage ist klein", "wie viele {} haben das formular ausgefuellt", "der bericht zaehlt {} je region"),
}

BAD = (
    # English: threats, demeaning words, sex
    "i will find you and hurt you", "i am going to break your legs", "watch your back tonight", "i know where you live and i will come for you", "you will pay for this with your blood", "i will beat you until you bleed",
    "i hope you die alone", "you should kill yourself", "do us a favour and die", "the world would be better without you", "you are worthless and everybody hates you", "your mother should be ashamed of you", "you are too stupid to breathe", "fuck you", "fuck off and die",
    "those people are animals and do not belong here", "their kind is filth and must be driven out", "that whole race is trash", "throw that rabble out of our land", "they breed like rats",
    "undress for me on camera", "girls who want sex with you tonight", "free porn, click here", "hot naked girls are waiting for you", "she undressed and he touched her naked body", "i want to sleep with you, sexy", "they had sex on the kitchen table", "she moaned while he was inside her", "he put his cock in her mouth", "send me nudes, baby",
    # Portuguese
    "vou te encontrar e te quebrar a cara", "vou quebrar as tuas pernas", "sei onde voce mora e vou te pegar", "vou acabar com voce", "voce vai pagar com sangue", "espero que voce morra", "se mata logo", "o mundo seria melhor sem voce", "voce nao vale nada e todo mundo te odeia", "vai se foder", "vai tomar no cu",
    "essa gente e lixo e nao presta", "esse povo e todo ladrao", "essa raca tem que sumir", "se reproduzem como ratos", "tira a roupa para mim na camera", "sexo gratis agora, clique aqui", "quero transar com voce hoje, gostosa", "garotas nuas esperando por voce", "eles transaram na mesa da cozinha", "ela gemia com ele dentro dela", "manda nudes, gata",
    # Spanish
    "te voy a encontrar y te rompo la cara", "te voy a romper las piernas", "se donde vives y voy por ti", "te vas a arrepentir, te lo juro", "lo vas a pagar con sangre", "ojala te mueras", "matate de una vez", "el mundo seria mejor sin ti", "no vales nada y todos te odian", "vete a la mierda", "que te jodan",
    "esa gente es basura y no vale nada", "ese pueblo es todo ladron", "esa raza tiene que desaparecer", "se reproducen como ratas", "quitate la ropa en camara para mi", "porno gratis, haz clic aqui", "quiero acostarme contigo hoy, guapa", "chicas desnudas te esperan", "follaron en la mesa de la cocina", "ella gemia con el dentro", "manda fotos desnuda, nena",
    # German
    "ich finde dich und breche dir die knochen", "ich schlage dir die zaehne aus", "ich weiss, wo du wohnst, und komme dich holen", "dich mache ich fertig", "das wirst du mit blut bezahlen", "ich hoffe, du stirbst", "bring dich um", "die welt waere ohne dich besser dran", "du bist wertlos und alle hassen dich", "fick dich", "leck mich am arsch",
    "dieses volk ist abschaum", "dieses gesindel gehoert rausgeworfen", "diese rasse muss weg", "die vermehren sich wie ratten", "zieh dich vor der kamera fuer mich aus", "gratis pornos, klick hier", "ich will heute sex mit dir, suesse", "nackte maedchen warten auf dich", "sie hatten sex auf dem kuechentisch", "sie stoehnte, als er in ihr war", "schick mir nacktbilder, schatz",
)

GOOD = (
    # English
    "this stupid script ate my file", "this lazy printer hates me", "my laptop is a drama queen", "the bloody thing crashed again", "the damn build is broken", "what a stupid bug", "i hate this ugly keyboard",
    "be polite or your post will be removed", "no swearing in this forum, please", "posts with insults, threats or sexual content are deleted", "report abusive users to the moderators",
    "kill the process and its children", "abort the job and orphan the branch", "the daemon left zombies behind", "the master kills the slave node", "the worker dies after an hour", "how do i kill a hanging query", "a dummy variable for each level", "the male and the female connector", "dirty reads and naked pointers", "a dumb terminal", "the garbage collector runs too often", "strip the suffix and touch the file", "penetration test of the server",
    "swimwear and lingerie by size", "garden sprays against rats and other pests", "adult sizes are in the clothing category", "sex toys are not sold in this category", "a black dress and white shoes", "pig farms by county",
    "screening for cervical cancer", "sexual transmission of the virus in adults", "age, sex and weight of each patient", "breast cancer and prostate cancer cases", "pregnancy after unprotected sex", "naked eye examination of the skin",
    "thanks, that solved it for me", "how do i join two tables", "the query returns too many rows", "i hope this helps you", "the file lives in another folder", "the function removes spaces", "you are right, i missed that", "you can read it in the manual", "what you are looking for is a window function", "i will find the log and send it to you",
    # Portuguese
    "esse programa burro apagou meu arquivo", "essa impressora me odeia", "que erro estupido no codigo", "seja educado com os outros", "mensagens com insultos, ameacas ou conteudo sexual sao apagadas", "mate o processo e os filhos", "o processo filho morre depois de uma hora", "o processo foi encerrado pelo sistema", "o conector macho e o conector femea", "coletor de lixo da memoria", "moda praia e roupa intima por tamanho", "idade e sexo dos pacientes", "transmissao sexual do virus em adultos", "cancer de mama por faixa de idade",
    "como junto duas tabelas", "obrigado, funcionou", "voce tem razao, nao vi isso", "voce pode ler no manual", "o arquivo fica em outra pasta", "a consulta devolve linhas demais", "vou procurar o registro e te mando",
    # Spanish
    "este programa tonto borro mi archivo", "esta impresora me odia", "que error tan estupido en el codigo", "se ruega respeto a todos", "se borran mensajes con insultos, amenazas o contenido sexual", "mata el proceso y sus hijos", "el proceso hijo muere despues de una hora", "el proceso fue cerrado por el sistema", "el conector macho y el conector hembra", "recolector de basura de la memoria", "trajes de bano y ropa interior por talla", "edad y sexo de los pacientes", "transmision sexual del virus en adultos", "cancer de mama por edad",
    "como uno dos tablas", "gracias, funciono", "tienes razon, no lo vi", "puedes leerlo en el manual", "el archivo esta en otra carpeta", "la consulta devuelve demasiadas filas", "voy a buscar el registro y te lo mando",
    # German
    "dieses dumme skript hat meine datei geloescht", "dieser drucker hasst mich", "so ein bloeder fehler im code", "bitte freundlich bleiben", "beitraege mit beleidigungen, drohungen oder sexuellen inhalten werden geloescht", "den prozess und seine kinder beenden", "der kindprozess stirbt nach einer stunde", "der prozess wurde vom system beendet", "der stecker und die buchse", "die speicherbereinigung raeumt muell weg", "bademode und unterwaesche nach groesse", "alter und geschlecht der patienten", "sexuelle uebertragung des virus bei erwachsenen", "brustkrebs nach alter",
    "wie verbinde ich zwei tabellen", "danke, das hat geholfen", "du hast recht, das habe ich uebersehen", "das kannst du im handbuch lesen", "die datei liegt in einem anderen ordner", "die abfrage liefert zu viele zeilen", "ich suche das protokoll und schicke es dir",
)


def _filled(names: dict[str, tuple[str, ...]], frames: dict[str, tuple[str, ...]], turn: int) -> list[str]:
    return [frame.format(name) for lang, own in names.items() for i, name in enumerate(own) for k, frame in enumerate(frames[lang]) if (i + k) % turn == 0]


def bad() -> list[str]:
    """The bad sentences."""
    return [*BAD, *_filled(NAMES, ABUSE, TURN), *_filled(GROUPS, HATE, TURN)]


def good() -> list[str]:
    """The good sentences."""
    return [*GOOD, *_filled(NAMES, HARMLESS, TURN), *_filled(GROUPS, NEUTRAL, TURN)]
