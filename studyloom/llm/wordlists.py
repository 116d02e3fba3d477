"""Closed-class words of five languages, shared by the operators that look at the frame of a sentence."""

from __future__ import annotations

# Articles, pronouns, prepositions, conjunctions, auxiliaries and common particles.
FUNCTION_WORDS = {
    "en": """a an the this that these those some any no each every all both either neither few many much more most other another such own same
        i you he she it we they me him her us them my your his its our their mine yours myself itself himself themselves who whom whose which what
        of in on at by for with about against between into through during before after above below to from up down over under near since until
        and or but nor so yet if because as while although though when where why how than whether once unless not only also too very just even then
        there here out off again further is am are was were be been being has have had having do does did doing will would shall should can cannot
        could may might must let upon within without per via according""",
    "de": """der die das den dem des ein eine einen einem einer eines kein keine keinen dieser diese dieses diesem jeder jede jedes alle beide mehrere
        ich du er sie es wir ihr mich mir dich dir ihn ihm uns euch ihnen mein dein sein seine ihre unser sich man wer wen wem was welche welcher welches
        in im an am auf aus bei beim bis durch für gegen hinter mit nach neben ohne seit über um unter von vom vor während wegen zu zum zur zwischen laut
        und oder aber denn sondern doch weil dass ob wenn als wie obwohl damit sobald falls je desto nicht nur auch noch schon sehr so dann da hier dort
        ist sind war waren bin bist sei wird werden wurde wurden worden hat haben hatte hatten kann können konnte muss müssen soll sollen will wollen darf
        möchte mag etwa kaum sowie dazu davon darauf daran dafür dabei allein außerdem warum weshalb worin wozu einmal""",
    "fr": """le la les l un une des du de d au aux ce cet cette ces ç chaque tout tous toute toutes plusieurs quelques aucun aucune autre même
        je j tu il elle on nous vous ils elles me m te t se s lui leur leurs y en mon ma mes ton ta tes son sa ses notre nos votre vos moi toi soi
        qui que qu quoi dont où quel quelle quels quelles lequel laquelle à dans par pour sur sous avec sans chez vers entre contre depuis pendant
        avant après jusque jusqu selon malgré et ou mais ni car donc or si comme quand lorsque lorsqu puisque parce tandis alors afin ne n pas plus
        moins très trop peu aussi ainsi encore déjà toujours jamais rien est sont était étaient être été fut furent a ont avait avoir eu sera serait
        peut peux doit faut fait lors près là ici voici surtout c""",
    "es": """el la los las lo un una unos unas al del este esta estos estas ese esa eso aquel cada todo toda todos todas algún alguna ningún ninguna otro otra
        yo tú él ella ello nosotros ellos ellas me te se nos le les mi tu su sus nuestro mí sí quien quién que qué cual cuál cuyo cuya cómo cuándo dónde
        a ante bajo con contra de desde durante en entre hacia hasta mediante para por según sin sobre tras y e o u ni pero sino aunque porque si como
        cuando mientras donde pues no ya muy más menos tan tanto también tampoco sólo solo apenas casi siempre nunca es son era eran ser sido fue fueron
        está están estaba estar ha han había haber he hay será sería puede puedo debe hace cerca además además así unos cabo vez""",
    "ru": """и а но да или либо ни что чтобы как так если когда пока хотя потому поэтому же ли бы не ни нет в во на с со к ко о об обо от до из изо у за
        над под при про для без через перед между после около вокруг среди против ради я ты он она оно мы вы они меня мне тебя тебе его её ей ему нас нам
        вас вам их им ними себя себе мой моя мое мои твой свой своя свое свои наш ваш этот эта это эти этого этой этому этом тот та то те того той том
        кто чего чему чем какой какая какие какую который которая которое которые где куда откуда почему зачем сколько весь вся все всё всего всех
        был была было были быть есть будет будут может можно нужно надо уже ещё еще только лишь даже очень более менее там здесь тут вот всё""",
}
LANGUAGES = tuple(FUNCTION_WORDS)
WORD_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
FRAME = frozenset().union(*WORD_SETS.values())
