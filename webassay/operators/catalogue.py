"""Technologies and the signals they show, as plain rows, and a reader of further rows from JSON.

The rows were chosen from what vendors document: the embed codes that they tell
their customers to paste, the headers and cookies that their servers set, and
the generator tags that their products write. A row is checked when it is
read, so a bad one fails on the driver and never on a page.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

CATEGORIES = ("analytics", "advertising", "cdn", "chat", "cms", "consent", "ecommerce", "font", "framework", "hosting", "javascript", "language", "page-builder", "payment", "security", "seo-plugin", "server", "tag-manager", "ui")
TYPES = ("bundle", "cookie", "dom", "header", "html", "js", "meta", "script", "stylesheet", "url")


class CatalogueError(ValueError):
    pass


@dataclass(frozen=True)
class Signal:
    """Where a technology shows: ``key`` names a header, meta tag, global or cookie pattern; ``version`` is a group of ``pattern``."""

    type: str
    key: str
    pattern: str
    confidence: float = 1.0
    version: int = 0
    case: bool = False
    technology: str = ""
    needs: str = ""


def header(name: str, pattern: str = ".", sure: float = 1.0, version: int = 0) -> Signal:
    return Signal("header", name, pattern, sure, version)


def cookie(name: str, sure: float = 0.9) -> Signal:
    return Signal("cookie", name, "", sure)


def js(name: str, sure: float = 0.9) -> Signal:
    return Signal("js", name, "", sure)


def generator(pattern: str, version: int = 0) -> Signal:
    return Signal("meta", "generator", pattern, 1.0, version)


def script(pattern: str, sure: float = 1.0, version: int = 0) -> Signal:
    return Signal("script", "", pattern, sure, version)


def style(pattern: str, sure: float = 0.9, version: int = 0) -> Signal:
    return Signal("stylesheet", "", pattern, sure, version)


def html(pattern: str, sure: float = 0.9, version: int = 0, case: bool = False) -> Signal:
    return Signal("html", "", pattern, sure, version, case)


def dom(tag: str, pattern: str, sure: float = 1.0, version: int = 0) -> Signal:
    return Signal("dom", tag, pattern, sure, version)


def url(pattern: str, sure: float = 0.8) -> Signal:
    return Signal("url", "", pattern, sure)


def bundle(pattern: str, sure: float = 0.8) -> Signal:
    return Signal("bundle", "", pattern, sure)


#: (technology, category, what it implies, signals)
ROWS: tuple[tuple[str, str, tuple[str, ...], tuple[Signal, ...]], ...] = (
    # Servers name themselves.
    ("Apache", "server", (), (header("server", r"^Apache(?:/(\d[\d.]*))?(?:\s|$)", version=1),)),
    ("Caddy", "server", (), (header("server", "^Caddy$"),)),
    ("Envoy", "server", (), (header("server", "^envoy$"), header("x-envoy-upstream-service-time", r"^\d+$", 0.9))),
    ("Gunicorn", "server", ("Python",), (header("server", r"^gunicorn(?:/(\d[\d.]*))?", version=1),)),
    ("Jetty", "server", ("Java",), (header("server", r"^Jetty\(?(\d[\w.]*)?", version=1),)),
    ("Kestrel", "server", ("ASP.NET",), (header("server", "^Kestrel$"),)),
    ("LiteSpeed", "server", (), (header("server", "^LiteSpeed"), header("x-litespeed-cache"))),
    ("Microsoft IIS", "server", (), (header("server", r"^Microsoft-IIS/(\d[\d.]*)", version=1),)),
    ("nginx", "server", (), (header("server", r"^nginx(?:/(\d[\d.]*))?", version=1),)),
    ("OpenResty", "server", ("nginx",), (header("server", r"^openresty(?:/(\d[\d.]*))?", version=1),)),
    ("Varnish", "server", (), (header("x-varnish"), header("via", r"\bvarnish\b", 0.9))),
    # Languages and the platforms around them.
    ("ASP.NET", "language", (), (header("x-aspnet-version", r"^(\d[\d.]*)", version=1), header("x-powered-by", r"^ASP\.NET"), cookie("^ASP.NET_SessionId$"), dom("input", 'name="__VIEWSTATE"', 0.9), url(r"\.aspx?(?:$|[?#])"))),
    ("Java", "language", (), (cookie("^JSESSIONID$"), url(r"\.jsp(?:$|[?#;])"))),
    ("PHP", "language", (), (header("x-powered-by", r"^PHP(?:/(\d[\d.]*))?", version=1), cookie("^PHPSESSID$"), url(r"\.php\d?(?:$|[?#])"))),
    ("Python", "language", (), (header("server", r"\b(?:CPython|WSGIServer|Python)/(\d[\d.]*)", version=1),)),
    ("Ruby", "language", (), (header("server", r"\bPhusion Passenger|\bPuma\b|\bWEBrick/"),)),
    # Frameworks on the server and in the browser.
    ("Alpine.js", "framework", (), (script(r"/alpinejs(?:@|/|\.)"), dom("div", "x-data", 0.8))),
    ("Angular", "framework", (), (dom("", r'\sng-version="(\d[\d.]*)', version=1), js("ng", 0.5))),
    ("Astro", "framework", (), (generator(r"^Astro v?(\d[\w.]*)", 1), html("<astro-island", 1.0))),
    ("Django", "framework", ("Python",), (cookie("^csrftoken$", 0.7), html('name="csrfmiddlewaretoken"'))),
    ("Express", "framework", (), (header("x-powered-by", "^Express$"),)),
    ("Gatsby", "framework", ("React",), (generator(r"^Gatsby (\d[\d.]*)", 1), html('id="___gatsby"', 1.0))),
    ("htmx", "framework", (), (script(r"/htmx(?:\.org|\.min)?[@.]"), js("htmx"))),
    ("Laravel", "framework", ("PHP",), (cookie("^laravel_session$", 1.0), cookie("^XSRF-TOKEN$", 0.3))),
    ("Livewire", "framework", ("Laravel",), (html("wire:(?:id|snapshot)=", 0.9), js("Livewire"))),
    ("Next.js", "framework", ("React",), (header("x-powered-by", r"^Next\.js(?: (\d[\d.]*))?", version=1), script("/_next/static/chunks/"), html('id="__NEXT_DATA__"', 1.0, case=True), js("__NEXT_DATA__"))),
    ("Nuxt", "framework", ("Vue.js",), (html('id="__nuxt"', 1.0), script("/_nuxt/entry"), js("$nuxt"))),
    ("React", "framework", (), (script(r"/react-dom(?:@(\d[\d.]*))?[/.]", 0.9, 1), dom("div", "data-reactroot", 0.9), bundle(r"react-dom\.production"))),
    ("Ruby on Rails", "framework", ("Ruby",), (Signal("meta", "csrf-param", "^authenticity_token$", 0.9), script("/rails-ujs", 0.8))),
    ("SvelteKit", "framework", (), (html("data-sveltekit-", 1.0), script("/_app/immutable/entry/"))),
    ("Symfony", "framework", ("PHP",), (header("x-debug-token"), html('id="sfwdt', 0.9))),
    ("Vue.js", "framework", (), (script(r"/vue(?:@(\d[\d.]*))?(?:/dist/vue)?\.(?:global|runtime|min|esm|prod|js)", 0.9, 1), dom("div", "data-v-app", 1.0), js("__VUE__"))),
    # Content management.
    ("Adobe Experience Manager", "cms", ("Java",), (html("/etc\\.clientlibs/"), html("/content/dam/", 0.5))),
    ("Contao", "cms", ("PHP",), (generator("^Contao Open Source CMS"),)),
    ("Craft CMS", "cms", ("PHP",), (header("x-powered-by", r"\bCraft CMS\b"), cookie("^CraftSessionId$"))),
    ("Drupal", "cms", ("PHP",), (generator(r"^Drupal (\d+)", 1), header("x-generator", r"^Drupal (\d+)", version=1), html('data-drupal-selector="'), js("Drupal"))),
    ("Ghost", "cms", (), (generator(r"^Ghost (\d[\d.]*)", 1), script("/ghost/portal@", 0.8))),
    ("Hugo", "cms", (), (generator(r"^Hugo (\d[\d.]*)", 1),)),
    ("Jekyll", "cms", ("Ruby",), (generator(r"^Jekyll v(\d[\d.]*)", 1),)),
    ("Joomla", "cms", ("PHP",), (generator("^Joomla!"), html("/media/system/js/core", 0.7))),
    ("MediaWiki", "cms", ("PHP",), (generator(r"^MediaWiki (\d[\w.-]*)", 1), js("mw", 0.6))),
    ("Moodle", "cms", ("PHP",), (cookie("^MoodleSession", 1.0), js("M", 0.1), html('content="moodle, ', 0.9))),
    ("Squarespace", "cms", (), (html("<!-- This is Squarespace", 1.0), html("assets\\.squarespace\\.com/"), js("Static", 0.2))),
    ("TYPO3", "cms", ("PHP",), (generator("^TYPO3"), html("/typo3temp/assets/"))),
    ("Webflow", "cms", (), (generator("^Webflow$"), dom("html", "data-wf-site"), html("cdn\\.prod\\.website-files\\.com/"))),
    ("Wix", "cms", (), (generator("^Wix\\.com Website Builder"), header("x-wix-request-id"), html("static\\.parastorage\\.com/"))),
    ("WordPress", "cms", ("PHP",), (generator(r"^WordPress(?: (\d[\w.-]*))?", 1), header("link", 'rel="https://api\\.w\\.org/"'), html("/wp-content/(?:themes|plugins|uploads)/"), script("/wp-includes/js/"), cookie("^wordpress_(?:logged_in|test_cookie|sec)"))),
    # Page builders and search plugins.
    ("Elementor", "page-builder", ("WordPress",), (generator(r"^Elementor (\d[\d.]*)", 1), html('class="elementor elementor-\\d+'), js("elementorFrontend"))),
    ("WPBakery", "page-builder", ("WordPress",), (generator("^Powered by WPBakery"), html('class="vc_row wpb_row', 0.9))),
    ("All in One SEO", "seo-plugin", ("WordPress",), (generator(r"^All in One SEO \(AIOSEO\) (\d[\d.]*)", 1), html('class="aioseo-schema"'))),
    ("Rank Math", "seo-plugin", ("WordPress",), (html("Search Engine Optimization by Rank Math", 1.0), html('class="rank-math-schema'))),
    ("Yoast SEO", "seo-plugin", ("WordPress",), (html(r"This site is optimized with the Yoast SEO (?:Premium )?plugin v(\d[\d.]*)", 1.0, 1), html('class="yoast-schema-graph'))),
    # Shops and payment.
    ("BigCommerce", "ecommerce", (), (html("cdn\\d*\\.bigcommerce\\.com/"), cookie("^SHOP_SESSION_TOKEN$"))),
    ("Magento", "ecommerce", ("PHP",), (header("x-magento-tags"), html('type="text/x-magento-init"', 1.0), cookie("^mage-cache-sessid$"))),
    ("PrestaShop", "ecommerce", ("PHP",), (generator("^PrestaShop$"), js("prestashop"), cookie("^PrestaShop-[0-9a-f]+"))),
    ("Shopify", "ecommerce", (), (header("x-shopify-stage"), html("cdn\\.shopify\\.com/s/files/"), js("Shopify"), cookie("^_shopify_y$"))),
    ("Shopware", "ecommerce", ("PHP",), (html("data-plugin-[a-z]+.*?shopware", 0.5), header("sw-version-id"), cookie("^sw-context-token$"))),
    ("WooCommerce", "ecommerce", ("WordPress",), (generator(r"^WooCommerce (\d[\d.]*)", 1), script("/woocommerce/assets/js/"), cookie("^woocommerce_cart_hash$"))),
    ("Adyen", "payment", (), (script("checkoutshopper-[a-z-]+\\.adyen\\.com/"),)),
    ("Klarna", "payment", (), (script("js\\.klarna\\.com/|x\\.klarnacdn\\.net/"),)),
    ("PayPal", "payment", (), (script("^https?://www\\.paypal(?:objects)?\\.com/"),)),
    ("Stripe", "payment", (), (script("^https://js\\.stripe\\.com/v(\\d+)", version=1), cookie("^__stripe_mid$"))),
    # Measurement and advertising.
    ("Adobe Analytics", "analytics", (), (script("/AppMeasurement(?:\\.min)?\\.js"), js("s_account", 0.8))),
    ("Amplitude", "analytics", (), (script("cdn\\.amplitude\\.com/"),)),
    ("Google Analytics", "analytics", (), (script("googletagmanager\\.com/gtag/js\\?id=G-"), html("gtag\\(.config., ?.G-[A-Z0-9]{6,}", 1.0, case=True), cookie("^_ga$", 0.8), bundle("google-analytics\\.com/g/collect"))),
    ("Hotjar", "analytics", (), (html("static\\.hotjar\\.com/c/hotjar-", 1.0), cookie("^_hjSessionUser_"))),
    ("Matomo", "analytics", (), (script("/(?:matomo|piwik)\\.js"), js("Matomo"), cookie("^_pk_id\\."))),
    ("Microsoft Clarity", "analytics", (), (html("www\\.clarity\\.ms/tag/", 1.0), cookie("^_clck$"))),
    ("Mixpanel", "analytics", (), (script("cdn\\.mxpnl\\.com/"), js("mixpanel"))),
    ("Plausible", "analytics", (), (script("plausible\\.io/js/script"), dom("script", "data-domain", 0.5))),
    ("Segment", "analytics", (), (html("cdn\\.segment\\.com/analytics\\.js/v1/", 1.0),)),
    ("Yandex Metrica", "analytics", (), (html("mc\\.yandex\\.ru/metrika/tag\\.js", 1.0),)),
    ("Google Tag Manager", "tag-manager", (), (html("googletagmanager\\.com/gtm\\.js", 1.0), html("googletagmanager\\.com/ns\\.html\\?id=GTM-", 1.0, case=True), bundle("googletagmanager\\.com/gtm\\.js"))),
    ("Tealium", "tag-manager", (), (script("tags\\.tiqcdn\\.com/utag/"), js("utag"))),
    ("Google AdSense", "advertising", (), (script("pagead2\\.googlesyndication\\.com/pagead/js/adsbygoogle"),)),
    ("LinkedIn Insight", "advertising", (), (html("snap\\.licdn\\.com/li\\.lms-analytics/", 1.0),)),
    ("Meta Pixel", "advertising", (), (html("connect\\.facebook\\.net/[a-z_]+/fbevents\\.js", 1.0), cookie("^_fbp$"))),
    ("TikTok Pixel", "advertising", (), (html("analytics\\.tiktok\\.com/i18n/pixel/", 1.0),)),
    # Consent, chat, security.
    ("Cookiebot", "consent", (), (script("consent\\.cookiebot\\.com/uc\\.js"), cookie("^CookieConsent$", 0.6))),
    ("Didomi", "consent", (), (html("sdk\\.privacy-center\\.org/"), js("Didomi"))),
    ("iubenda", "consent", (), (script("cdn\\.iubenda\\.com/"),)),
    ("OneTrust", "consent", (), (script("cdn\\.cookielaw\\.org/"), cookie("^OptanonConsent$"))),
    ("Usercentrics", "consent", (), (script("app\\.usercentrics\\.eu/"), html('id="usercentrics-root"', 1.0))),
    ("Consent banner", "consent", (), (html("cookie[-_ ]?(?:consent|banner|notice)", 0.6), bundle("cookie-?consent", 0.6))),
    ("Crisp", "chat", (), (html("client\\.crisp\\.chat/l\\.js", 1.0), js("$crisp"))),
    ("Intercom", "chat", (), (html("widget\\.intercom\\.io/widget/", 1.0), js("Intercom"))),
    ("LiveChat", "chat", (), (html("cdn\\.livechatinc\\.com/tracking\\.js", 1.0),)),
    ("Zendesk", "chat", (), (script("static\\.zdassets\\.com/ekr/snippet"), js("zE", 0.8))),
    ("hCaptcha", "security", (), (script("(?:js\\.)?hcaptcha\\.com/1/api\\.js"), dom("div", "h-captcha", 0.5))),
    ("Imperva", "security", (), (header("x-iinfo"), cookie("^incap_ses_", 1.0), cookie("^visid_incap_", 1.0))),
    ("reCAPTCHA", "security", (), (script("/recaptcha/(?:api|enterprise)\\.js"), js("grecaptcha"))),
    ("Sucuri", "security", (), (header("x-sucuri-id"), header("server", "^Sucuri/Cloudproxy"))),
    ("Turnstile", "security", (), (script("challenges\\.cloudflare\\.com/turnstile/v0/"),)),
    # Delivery and hosting.
    ("Akamai", "cdn", (), (header("server", "^AkamaiGHost$"), header("x-akamai-request-id"), cookie("^ak_bmsc$", 0.8))),
    ("Amazon CloudFront", "cdn", (), (header("x-amz-cf-pop"), header("via", r"\(CloudFront\)"))),
    ("bunny.net", "cdn", (), (header("server", "^BunnyCDN-"),)),
    ("Cloudflare", "cdn", (), (header("server", "^cloudflare$"), header("cf-ray", "^[0-9a-f]+"), cookie("^__cf_bm$"))),
    ("Fastly", "cdn", (), (header("x-fastly-request-id"), header("x-served-by", "^cache-[a-z]", 0.7))),
    ("Amazon S3", "hosting", (), (header("server", "^AmazonS3$"), header("x-amz-id-2", ".", 0.8))),
    ("Fly.io", "hosting", (), (header("server", "^Fly/"), header("fly-request-id"))),
    ("GitHub Pages", "hosting", (), (header("server", "^GitHub\\.com$"), url("^https?://[^/]+\\.github\\.io/"))),
    ("Heroku", "hosting", (), (header("via", "vegur"), header("reporting-endpoints", "heroku-nel"))),
    ("Kinsta", "hosting", (), (header("x-kinsta-cache"),)),
    ("Netlify", "hosting", (), (header("server", "^Netlify"), header("x-nf-request-id"))),
    ("Pantheon", "hosting", (), (header("x-pantheon-styx-hostname"),)),
    ("Vercel", "hosting", (), (header("server", "^Vercel$"), header("x-vercel-cache"))),
    ("WP Engine", "hosting", ("WordPress",), (header("x-powered-by", "^WP Engine"), header("wpe-backend"))),
    # Libraries, styles, fonts.
    ("Chart.js", "javascript", (), (script("/chart(?:\\.umd|\\.min)*\\.js"),)),
    ("D3", "javascript", (), (script("/d3(?:\\.v(\\d+))?(?:\\.min)?\\.js", 0.9, 1), js("d3", 0.7))),
    ("GSAP", "javascript", (), (script("/gsap(?:\\.min)?\\.js"), js("gsap"))),
    ("jQuery", "javascript", (), (script(r"/jquery(?:[-.](\d+(?:\.\d+)+))?(?:\.slim)?(?:\.min)?\.js", 0.9, 1), js("jQuery"))),
    ("Lodash", "javascript", (), (script("/lodash(?:@(\\d[\\d.]*))?(?:/lodash)?(?:\\.min)?\\.js", 0.9, 1),)),
    ("three.js", "javascript", (), (script("/three(?:\\.module|\\.min)?\\.js"), js("THREE"))),
    ("Bootstrap", "ui", (), (style(r"/bootstrap(?:@|[-.])?(\d+(?:\.\d+)+)?(?:/dist/css/bootstrap)?(?:\.min)?\.css", 0.9, 1), script("/bootstrap(?:\\.bundle)?(?:\\.min)?\\.js", 0.8))),
    ("Bulma", "ui", (), (style("/bulma(?:\\.min)?\\.css"),)),
    ("Tailwind CSS", "ui", (), (script("cdn\\.tailwindcss\\.com"), html("--tw-(?:ring|shadow|translate)-", 0.8))),
    ("Adobe Fonts", "font", (), (style("use\\.typekit\\.net/"), script("use\\.typekit\\.net/"))),
    ("Font Awesome", "font", (), (script("kit\\.fontawesome\\.com/"), style("/font-?awesome(?:\\.min)?\\.css|use\\.fontawesome\\.com/"))),
    ("Google Fonts", "font", (), (style("fonts\\.googleapis\\.com/css", 1.0),)),
)


@dataclass(frozen=True)
class Catalogue:
    category: dict[str, str]
    implies: tuple[tuple[str, str], ...]
    signals: tuple[Signal, ...]


def required_text(pattern: str, least: int = 4) -> str:
    """A lower-case text that every match holds, for a cheap test before the pattern; empty where none is plain to see.

    Read off the parsed pattern: plain signs that follow each other outside of
    groups, sets and repeats.
    """
    best, run = "", ""
    for op, value in re._parser.parse(pattern):
        run = run + chr(value) if op is re._constants.LITERAL else ""
        best = max(best, run, key=len)
    return best.lower() if len(best) >= least else ""


def checked(name: str, s: Signal) -> Signal:
    """The signal with its technology and required text; an error that names what is wrong with it."""
    if s.type not in TYPES:
        raise CatalogueError(f"{name}: unknown type of signal {s.type!r}")
    if not 0 < s.confidence <= 1:
        raise CatalogueError(f"{name}: confidence {s.confidence} isn't in (0, 1]")
    try:
        groups = re.compile(s.pattern).groups
        re.compile(s.key if s.type == "cookie" else "")
    except re.error as e:
        raise CatalogueError(f"{name}: {s.pattern or s.key}: {e}") from e
    if s.version > groups:
        raise CatalogueError(f"{name}: {s.pattern} has no group {s.version}")
    if not (s.key or s.pattern) or s.type in ("header", "meta", "js", "cookie") and not s.key:
        raise CatalogueError(f"{name}: a {s.type} signal without what it looks for")
    return replace(s, technology=name, needs=required_text(s.pattern) if s.type == "html" else "")


def longest_chain(implies: tuple[tuple[str, str], ...]) -> int:
    """Steps of the longest chain of implications; an error where they go in a circle."""
    depth, todo = {}, list(implies)
    while todo:
        open_ = {a for a, _ in todo}
        ready = [(a, b) for a, b in todo if b not in open_]
        if not ready:
            raise CatalogueError(f"implications go in a circle: {sorted(open_)}")
        for a, b in ready:
            depth[a] = max(depth.get(a, 0), depth.get(b, 0) + 1)
        todo = [x for x in todo if x not in ready]
    return max(depth.values(), default=0)


def build(rows=ROWS) -> Catalogue:
    """Check rows; of rows with one name the last counts, so that further rows can replace some."""
    by_name = {name: (category, implies, signals) for name, category, implies, signals in rows}
    for name, (category, implies, signals) in by_name.items():
        if category not in CATEGORIES:
            raise CatalogueError(f"{name}: unknown category {category!r}")
        for parent in implies:
            if parent not in by_name:
                raise CatalogueError(f"{name} implies {parent!r}, which isn't there")
        if not signals:
            raise CatalogueError(f"{name}: no signals")
    longest_chain(tuple((name, parent) for name, row in by_name.items() for parent in row[1]))
    return Catalogue(
        {name: row[0] for name, row in by_name.items()},
        tuple((name, parent) for name, row in by_name.items() for parent in row[1]),
        tuple(checked(name, s) for name, row in by_name.items() for s in row[2]),
    )


def read_json(text: str, rows=ROWS) -> Catalogue:
    """``rows`` with those of a JSON list added: {name, category, implies?, signals: [{type, key?, pattern?, confidence?, version?, case?}]}.

    ``case: true`` makes a signal heed case.
    """
    try:
        more = [(x["name"], x["category"], tuple(x.get("implies", ())), tuple(Signal(s["type"], s.get("key", ""), s.get("pattern", ""), float(s.get("confidence", 1.0)), int(s.get("version", 0)), bool(s.get("case", False))) for s in x["signals"])) for x in json.loads(text)]
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        raise CatalogueError(f"rules can't be read: {e!r}") from e
    return build((*rows, *more))
