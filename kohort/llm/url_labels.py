"""A small table of labelled urls, written for this library; the names are made up, the domains reserved."""

# Names of hosts to be blocked and to be allowed.
BLOCKED_NAMES = """casino-royal online-casino casino777 win-big-casino bestcasino free-spins poker-win betting-tips sports-bets free-betting bets24 winbets
lotto-win jackpot-slots slot-machine casino-bonus cheap-meds buy-pills diet-pills pills-online cheap-viagra pharma-cheap cheap-watches cheap-loans
payday-loans replica-bags discount-pills adult-chat xxx-videos adult-dating hot-adult porn-tube sexcams adult-movies xxx-free nude-cams adult-shop
spam-links link-farm spamfarm buy-backlinks seo-spam click-farm content-farm spam-mail farm-links free-gift-card free-iphone win-prizes
get-rich-quick fast-money crypto-doubler free-crypto warez-free crack-keygen torrent-xxx miracle-cure weight-loss-pills""".split()
ALLOWED_NAMES = """wikipedia python spark-docs daily-news smith university library museum cityhall weather recipes gardening travel school mountain-hikes
river-fishing science-notes open-data health-advice law-review book-club music-theory film-critics chess-club knitting history-of-art maths physics
gardens cycling parents theatre thorn other wheat northern thehand tension station reading-room orchard harbour heathland stable anthem edition interior
erasmus thread therein brother weather-map earth south-end feather together""".split()
DOMAINS = ("example.com", "example.net", "example.org", "test")
FRONTS = ("", "www.", "blog.", "m.")
PATHS = ("/", "/en/12", "/de/345.html", "/fr/6789", "/es/1234/", "/page.html", "/about", "/en/4711")


def _urls(names: list[str]) -> list[str]:
    """Every name with two fronts, domains and paths, dealt alike for both labels so that only names tell them apart."""
    return [f"https://{FRONTS[(i + k) % 4]}{name}.{DOMAINS[(i // 4 + k) % 4]}{PATHS[(i + 3 * k) % 8]}" for i, name in enumerate(names) for k in (0, 1)]


BLOCKED, ALLOWED = _urls(BLOCKED_NAMES), _urls(ALLOWED_NAMES)
