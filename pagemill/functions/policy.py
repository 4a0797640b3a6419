"""Fixed values of the cleaning policy: host lists, names and patterns that results must agree on."""

from __future__ import annotations

# Hosts that libraries and fonts may come from.
TRUSTED_LIB_HOSTS = [
    "cdn.jsdelivr.net", "code.jquery.com", "cdnjs.cloudflare.com", "unpkg.com", "cdn.tailwindcss.com", "vjs.zencdn.net",
    "fonts.googleapis.com", "fonts.gstatic.com", "ajax.googleapis.com", "stackpath.bootstrapcdn.com", "maxcdn.bootstrapcdn.com",
]
# The operator's own hosts for images and media; placeholders, to be set by whoever runs the engine.
OWN_ASSET_HOSTS = ["assets.example.com", "media.example.com"]
# Hosts whose paths name the tenant, the packages trusted there, and the kinds for which that counts.
MULTITENANT_HOSTS = ["cdn.jsdelivr.net", "unpkg.com"]
TRUSTED_PACKAGES = [
    "jquery", "bootstrap", "@popperjs/core", "popper.js", "swiper", "slick-carousel", "owl.carousel", "aos", "gsap", "lodash",
    "@fortawesome/fontawesome-free", "font-awesome", "animate.css", "normalize.css",
]
PATH_CHECKED_KINDS = ["script", "stylesheet", "iframe", "media"]
# Schemes that carry or embed content.
DANGEROUS_SCHEMES = ["javascript", "vbscript", "data", "blob", "filesystem"]
# Tracker hosts; those with a slash match anywhere in a URL.
TRACKER_HOSTS = [
    "google-analytics.com", "googletagmanager.com", "googletagservices.com", "googleadservices.com", "googlesyndication.com",
    "doubleclick.net", "g.doubleclick.net", "stats.g.doubleclick.net", "region1.analytics.google.com", "analytics.google.com",
    "googleoptimize.com", "mc.yandex.ru", "mc.yandex.com", "yandex.ru/metrika", "metrika.yandex.ru", "connect.facebook.net",
    "facebook.com/tr", "static.hotjar.com", "hotjar.com", "crazyegg.com", "cdn.mxpnl.com", "api.mixpanel.com", "cdn.segment.com",
    "api.segment.io", "api.amplitude.com", "widget.intercom.io", "js.intercomcdn.com", "js.hsforms.net", "hubspot.com",
    "js.hs-scripts.com", "js.hs-banner.com", "js.driftt.com", "embed.tawk.to", "client.crisp.chat", "optimonk.com",
    "cdn-asset.optimonk.com", "cdn-account.optimonk.com", "cdn-limit.optimonk.com", "front.optimonk.com", "gs-cdn.optimonk.com",
    "splithero.com", "app.splithero.com", "postaffiliatepro.com", "cloudflareinsights.com", "static.cloudflareinsights.com",
    "snapchat.com/p", "analytics.tiktok.com", "tiktok.com/i18n/pixel", "pinterest.com/ct", "ct.pinterest.com", "bat.bing.com",
    "sentry.io", "browser.sentry-cdn.com", "www.clarity.ms", "clarity.ms", "snap.licdn.com", "px.ads.linkedin.com",
    "static.ads-twitter.com", "analytics.twitter.com", "mc.vk.com", "vk.com/rtrg", "cdn.taboola.com", "amplify.outbrain.com",
    "consent.cookiebot.com", "consentcdn.cookiebot.com", "cdn.cookielaw.org", "cookiehub.com", "static.zdassets.com",
    "cdn.livechatinc.com", "cdn.heapanalytics.com", "heapanalytics.com",
]
# Parts of file names that mean a tracker.
TRACKER_FILES = [
    "fbevents", "fbq", "facebook-pixel", "gtag", "gtm", "ga.js", "analytics.js", "google-analytics", "googletagmanager", "metrika",
    "yandex_metrika", "hotjar", "mixpanel", "amplitude", "segment", "intercom", "postaffiliate", "pap", "optimonk", "splithero",
    "crazyegg", "clarity", "pixel", "beacon", "sendbeacon", "tracker", "tracking", "retarget", "conversion", "remarketing",
    "linkedin-insight", "lintrk", "twq", "tiktok-pixel", "snapchat-pixel", "pinterest-tag", "taboola", "outbrain", "cookiebot",
    "cookieconsent", "onetrust", "hubspot", "hs-scripts", "livechat", "zendesk", "zdassets", "driftt", "tawk", "crisp", "sentry",
    "heap", "vk-pixel", "vk-retargeting",
]
# Text in an inline script that means a tracker.
INLINE_KEYWORDS = [
    "gtag(", "gtag.js", "GoogleAnalyticsObject", "_gaq.push", "window.dataLayer", "dataLayer.push", "fbq(",
    "!function(f,b,e,v,n,t,s)", "connect.facebook.net", "ym(", "(function(m,e,t,r,i,k,a)", "yandex_metrika", "hjid", "hotjar",
    "mixpanel", "analytics.load", "amplitude.getInstance", "Intercom(", "window.Intercom", "PostAffTracker", "PAPCookie",
    "OptiMonk", "window.OptiMonk", "SplitHero", "splithero", "crazyegg", "_paq.push", "_hsq.push", "beacon.min.js", "cf-beacon",
    "clarity(", "window.clarity", "_linkedin_data_partner_id", "lintrk(", "twq(", "CookieConsent", "Cookiebot", "OneTrust",
    "OptanonWrapper", "heap.load(", "window.heap", "VK.Retargeting", "zE(", "zEmbed", "LiveChatWidget",
]
# Names of verification metas.
VERIFICATION_METAS = [
    "google-site-verification", "msvalidate.01", "yandex-verification", "facebook-domain-verification", "p:domain_verify",
    "norton-safeweb-site-verification", "alexaVerifyID", "wot-verification",
]
# Macros that stay.
OWN_MACROS = ["{offer}", "{_offer_value:offername}", "{_offer_value:offerimage}"]
# Fixed value: types of scripts that are JavaScript.
JAVASCRIPT_TYPE = r"^(text|application)/(x-)?(java|ecma)script\z"
MACRO = r"\{[a-zA-Z0-9_:.\-]+\}"
# Script code to look at by hand, label and pattern.
JS_WARNINGS = [
    ("fetch()", r"\bfetch\s*\("),
    ("XMLHttpRequest", r"new\s+XMLHttpRequest\s*\("),
    ("sendBeacon", r"navigator\.sendBeacon\s*\("),
    ("WebSocket", r"new\s+WebSocket\s*\("),
    ("document.write", r"document\.write\s*\("),
    ("localStorage", r"\blocalStorage\s*\."),
    ("sessionStorage", r"\bsessionStorage\s*\."),
    ("keylogger (addEventListener key*)", r"document\.addEventListener\s*\(\s*['\"]key"),
    ("atob()", r"\batob\s*\("),
    ("String.fromCharCode", r"String\.fromCharCode\s*\("),
    ("window.location redirect", r"window\.location\s*="),
    ("location.href redirect", r"location\.href\s*="),
    ("location.replace redirect", r"location\.replace\s*\("),
    ("Clipboard API", r"navigator\.clipboard\s*\."),
    ("postMessage", r"\bpostMessage\s*\("),
]
# Server-side code that looks like a back door, label and pattern.
PHP_BACKDOORS = [
    ("eval of user input", r"(?i)eval\s*\(\s*\$_(POST|GET|REQUEST|COOKIE)"),
    ("assert of user input", r"(?i)assert\s*\(\s*\$_(POST|GET|REQUEST)"),
    ("system with user input", r"(?i)system\s*\(\s*\$_(GET|POST|REQUEST)"),
    ("preg_replace /e", r"(?i)preg_replace\s*\([^,]+/e[^,]*,"),
    ("base64_decode chain", r"(?i)base64_decode\s*\([^)]+\)\s*;?\s*\)"),
    ("gzinflate of base64", r"(?i)gzinflate\s*\(\s*base64_decode"),
    ("move_uploaded_file", r"(?i)move_uploaded_file\s*\([^)]+\)"),
    ("passthru with user input", r"(?i)passthru\s*\(\s*\$_(GET|POST)"),
    ("shell_exec with user input", r"(?i)shell_exec\s*\(\s*\$_(GET|POST|REQUEST)"),
    ("exec with user input", r"(?i)exec\s*\(\s*\$_(GET|POST|REQUEST)"),
]
# Query names and path parts of offers; paths of pages that inform.
OFFER_PARAMETERS = ["_lp=", "_token=", "click_id=", "subid=", "sub_id=", "affiliate=", "aff_id=", "offer=", "order=", "checkout=", "buy=", "redirect=", "goto=", "campaign=", "adset=", "pixel=", "fbclid=", "utm_"]
OFFER_PATHS = ["click", "redirect", "go", "offer", "order", "checkout", "buy"]
INFO_PATHS = ["privacy", "policy", "privacy-policy", "terms", "terms-of-service", "tos", "contact", "about", "faq", "help", "support", "blog", "news"]
# Libraries by file name (pattern, and where the official copy of a version is).
LIBRARIES = [
    ("jquery", r"^jquery(-[\d.]+)?(\.slim)?(\.min)?\.js$", "https://code.jquery.com/jquery-{v}.min.js"),
    ("bootstrap-js", r"^bootstrap(-[\d.]+)?(\.bundle)?(\.min)?\.js$", "https://cdn.jsdelivr.net/npm/bootstrap@{v}/dist/js/bootstrap.bundle.min.js"),
    ("bootstrap-css", r"^bootstrap(-[\d.]+)?(\.min)?\.css$", "https://cdn.jsdelivr.net/npm/bootstrap@{v}/dist/css/bootstrap.min.css"),
    ("popper", r"^popper(-[\d.]+)?(\.min)?\.js$", "https://cdn.jsdelivr.net/npm/@popperjs/core@{v}/dist/umd/popper.min.js"),
    ("swiper-js", r"^swiper(-bundle)?(-[\d.]+)?(\.min)?\.js$", "https://cdn.jsdelivr.net/npm/swiper@{v}/swiper-bundle.min.js"),
    ("swiper-css", r"^swiper(-bundle)?(-[\d.]+)?(\.min)?\.css$", "https://cdn.jsdelivr.net/npm/swiper@{v}/swiper-bundle.min.css"),
    ("slick", r"^slick(-[\d.]+)?(\.min)?\.js$", "https://cdn.jsdelivr.net/npm/slick-carousel@{v}/slick/slick.min.js"),
    ("owl-carousel", r"^owl\.carousel(-[\d.]+)?(\.min)?\.js$", "https://cdn.jsdelivr.net/npm/owl.carousel@{v}/dist/owl.carousel.min.js"),
    ("aos", r"^aos(-[\d.]+)?(\.min)?\.js$", "https://cdn.jsdelivr.net/npm/aos@{v}/dist/aos.js"),
    ("gsap", r"^gsap(-[\d.]+)?(\.min)?\.js$", "https://cdn.jsdelivr.net/npm/gsap@{v}/dist/gsap.min.js"),
]
# Directories by kind of file.
DIRECTORIES = {
    "css": ["css", "scss", "sass", "less", "styl"], "js": ["js", "cjs", "mjs", "jsx"],
    "images": ["jpg", "jpeg", "jfif", "png", "gif", "svg", "webp", "avif", "apng", "ico", "bmp", "tiff", "tif", "heic", "heif"],
    "fonts": ["woff", "woff2", "ttf", "eot", "otf"], "video": ["mp4", "webm", "ogv", "mov"],
    "audio": ["mp3", "ogg", "oga", "wav", "aac", "m4a", "flac", "opus"], "assets": ["pdf", "zip", "json", "xml", "txt", "wasm"],
}
# Where product names are shown besides texts, and elements whose texts don't show any.
NAME_ATTRIBUTES = ["alt", "title", "aria-label", "placeholder"]
NAME_METAS = ["description", "keywords", "og:title", "og:description", "twitter:title", "twitter:description"]
NAME_SKIPPED = ["script", "style", "template", "textarea", "pre", "code", "noscript"]
# Attributes with an image's address, those that would outdo src, and signs of images that show no product.
IMAGE_ATTRIBUTES = ["src", "srcset", "poster", "data-src", "data-srcset", "data-lazy-src", "data-original"]
RESPONSIVE_ATTRIBUTES = ["srcset", "sizes", "data-src", "data-srcset", "data-lazy-src", "data-lazy", "data-original"]
NO_PRODUCT = r"(?i)logo|sprite|favicon|payment|paypal|visa|master(?:card)?|amex|discover|\bicon\b|icon[-_]|[-_]icon|arrow|chevron|badge|spinner|loader"
TINY_PIXELS = 48
# Elements that load something, their attributes with one address and with several, extensions of what is fetched.
ASSET_TAGS = ["link", "script", "img", "source", "video", "audio", "iframe", "embed", "object", "track", "input", "use"]
ADDRESS_ATTRIBUTES = ["href", "src", "data-src", "data-original", "data-lazy", "data-bg", "data-background", "data-image", "poster", "xlink:href"]
SRCSET_ATTRIBUTES = ["srcset", "data-srcset", "imagesrcset"]
ASSET_EXTENSIONS = [
    "css", "js", "mjs", "png", "jpg", "jpeg", "webp", "gif", "svg", "ico", "avif", "bmp", "woff", "woff2", "ttf", "otf", "eot",
    "mp4", "webm", "ogg", "mp3", "wav", "m4a", "json", "xml", "txt",
]
# Extensions of files that are pages only where they have server code.
SERVER_EXTENSIONS = ["phtml", "inc", "php3", "php4", "php5", "php7", "phps"]
# Libraries by their code (name, signature, version in group 1 or 2, version where none is found, where the official copy is).
LIBRARY_CODE = [
    ("jquery", r"(?i)jQuery\.fn\.jquery\s*=|jQuery JavaScript Library", r"""jQuery(?:\.fn\.jquery)?\s*=\s*["']([\d.]+)["']|jQuery\s+(?:JavaScript\s+Library\s+)?v([\d.]+)""", "3.7.1", "https://code.jquery.com/jquery-{v}.min.js"),
    ("bootstrap-js", r"Bootstrap v[\d.]+ \(https://getbootstrap\.com/?\)", r"Bootstrap v([\d.]+)()", "5.3.3", "https://cdn.jsdelivr.net/npm/bootstrap@{v}/dist/js/bootstrap.bundle.min.js"),
    ("popper", r"\* Popper\.js v[\d.]+|@popperjs/core", r"Popper\.js v([\d.]+)|@popperjs/core@([\d.]+)", "2.11.8", "https://cdn.jsdelivr.net/npm/@popperjs/core@{v}/dist/umd/popper.min.js"),
    ("swiper", r"(?i)Swiper\s+[\d.]+|Swiper JavaScript Library", r"Swiper\s+([\d.]+)()", "11.1.4", "https://cdn.jsdelivr.net/npm/swiper@{v}/swiper-bundle.min.js"),
    ("lodash", r"Lodash [\d.]+ \(Custom Build\)|lodash\.com/docs", r"Lodash ([\d.]+)()", "4.17.21", "https://cdn.jsdelivr.net/npm/lodash@{v}/lodash.min.js"),
]
#: The policy that clean pages carry; the hosts for images and media are those of OWN_ASSET_HOSTS.
_OWN = " ".join(f"https://{h}" for h in OWN_ASSET_HOSTS)
POLICY_TAG = (
    "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'self'; object-src 'none'; frame-src 'self'; form-action 'self'; "
    "script-src 'self' 'unsafe-inline' https://cdn.tailwindcss.com https://cdn.jsdelivr.net https://code.jquery.com https://vjs.zencdn.net; worker-src 'self' blob:; "
    "style-src 'self' 'unsafe-inline' https://fonts.googleapis.com https://vjs.zencdn.net; font-src 'self' data: https://fonts.googleapis.com https://fonts.gstatic.com https://vjs.zencdn.net; "
    f"media-src 'self' blob: {_OWN}; img-src 'self' data: {_OWN}; connect-src 'self' blob: {_OWN};\" />"
)

#: Fixed value: signs in a script that can't be read closely that it may send, load or lead away.
SUSPICIOUS = r"(?i)\bfetch\s*\(|\bXMLHttpRequest\b|\bsendBeacon\b|\bWebSocket\b|\beval\s*\(|\bnew\s+Function\b|\batob\s*\(|\bunescape\s*\(|\bfromCharCode\b|\bimportScripts\b|\bdocument\s*\.\s*write\b|\bnew\s+Image\b|\.\s*src\s*=|location\s*\.\s*(?:href|replace|assign)\b|\blocation\s*="
#: Categories of files by extension, and of responses by the kind of request; other kinds are categories of their own.
FILE_CATEGORIES = {
    "html": ["html", "htm"],
    "css": ["css"],
    "js": ["js", "mjs"],
    "image": ["png", "jpg", "jpeg", "webp", "gif", "svg", "ico", "avif"],
    "font": ["woff", "woff2", "ttf", "otf", "eot"],
    "media": ["mp4", "webm", "ogg", "mp3", "wav"],
}
REQUEST_CATEGORIES = {"document": "html", "stylesheet": "css", "script": "js", "image": "image", "font": "font", "media": "media", "fetch": "data", "xhr": "data"}
#: Percent of visual difference above which a person has to look.
VISUAL_LIMIT = 25
