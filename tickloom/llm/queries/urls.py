"""Operator 1: URL filters over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import urls
from tickloom.llm.registry import Tables, query

# The rules of this query (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Host words of the small labelled URL table the classifier learns from.
BLOCKED = """
casino-bonus casino-games lucky-casino casinos win-cash lottery-win
ads adserver ad-banner ads-click adtrack track tracker click-tracking pixel-track casino online-casino casino-slots
jackpot win-money big-win poker roulette bet bets free-bet sports-bets betting-odds free-spins adult adult-video adults-only
adult-xxx xxx-adult xxx porn sexcam cheap pills pills-cheap spam-farm spam farm-spam cheap-pills free-bets bets-free casino-win win-casino cheap-viagra buy-pills cheap-meds pharmacy-pills spam spam-links link-farm content-farm
replica-watches payday-loans warez crack-download free-money
""".split()
ALLOWED = """
university gardening weather museum cooking city-library newspaper history travel science hospital school football-club
orchestra theatre photography mountains bank government radio encyclopedia airport knitting mathematics chess observatory
linux-forum python-docs bakery trains archive the-theory thesis nation station other-things there through thinking thread
theme health earth north method author mother weather-report than then that this and-then on-the-road inner region union
version mention attention edition tradition reading morning evening building wedding orchard blended stable possible
relationship friendship township sunshine fashion stations nations motion ocean pension question action section function
shelter theatres together another brother gather leather feather rather whether neither lantern intern western eastern
winter center enter painter printer hunter ranger danger anger finger singer ginger orange change strange exchange
house mouse round sound ground mountain fountain thousand hand land island england holland thunder wonder under render
table cable noble double humble people simple temple example apple bottle little cattle battle settle title
heat wheat great treat theatre-club stone bone alone phone throne horse nurse course force source resource shore store
history-notes reader leader header older elder holder shoulder colder builder order border recorder garden student
fashionable questionable objectionable sizeable readable portable terrible sensible author anthem northern southern editor actor doctor
honest modest antonio tonight wagon lesson person season reason athens theory heron baron
assistant restaurant elephant giant plant grant important different present parent current event cement moment
""".split()
# Each word stands in every one of these places, so that they say nothing by themselves.
PLACES = ["http://{}.test/en/10", "https://www.{}.test/de/248.html", "http://m.{}.test/fr/5310/", "https://blog.{}.test/es/77?page=2#top", "http://{}.test/"]


def labelled(t: Tables):
    """A row per word and place: ``word, url, blocked``."""
    values = ", ".join(f"('{word}', {label})" for words, label in ((BLOCKED, 1), (ALLOWED, 0)) for word in words)
    words = t.spark.sql(f"SELECT * FROM VALUES {values} AS words(word, blocked)")
    rows = words.select("word", "blocked", F.explode(F.array(*[F.lit(p) for p in PLACES])).alias("place"))
    return rows.select("word", F.replace("place", F.lit("{}"), F.col("word")).alias("url"), "blocked")


@query("op1_url_filter", "op1")
def op1_url_filter(t: Tables):
    model = urls.fit_url_model(labelled(t))
    return urls.judge_urls(t.pages.select("page_id", "url"), model, RULES).select("page_id", "host", "path", "rule", "verdict", "score")
