"""Fixed values of the URL rules."""

# Registrable domains taken as legitimate.
TRUSTED_DOMAINS = (
    "google.com youtube.com facebook.com amazon.com microsoft.com apple.com netflix.com instagram.com twitter.com x.com linkedin.com reddit.com wikipedia.org github.com stackoverflow.com adobe.com paypal.com ebay.com "
    "yahoo.com live.com outlook.com office.com dropbox.com zoom.us salesforce.com slack.com wordpress.com shopify.com stripe.com tryhackme.com paruluniversity.ac.in"
).split()
# Brands whose names are imitated.
BRANDS = (
    "google facebook amazon microsoft apple paypal netflix instagram twitter linkedin ebay yahoo adobe whatsapp telegram discord gmail outlook office dropbox zoom spotify tiktok snapchat "
    "trezor ledger metamask coinbase binance kraken exodus phantom uniswap opensea blockchain bitcoin ethereum wallet"
).split()
# Words that make a brand in a host suspicious.
BRAND_CONTEXT = "login verify secure account update wallet".split()
# Top-level domains often abused.
SUSPICIOUS_TLDS = (
    ".tk .ml .ga .cf .gq .xyz .top .work .click .loan .men .review .racing .win .bid .download .stream .icu .club .info .online .site .website .space .tech .store .fun .live .cyou .sbs .cfd .boats .vip .pw .ninja .rocks .party .red .webcam .monster .wtf .faith .trade .science .shop .host"
).split()
# Phishing words counted in a URL.
KEYWORDS = (
    "login signin account verify update secure banking paypal ebay amazon apple microsoft google confirm suspended locked unusual click urgent immediately password credential wallet crypto invest prize winner free bonus gift limited expire claim "
    "trezor ledger metamask coinbase binance kraken exodus blockchain bitcoin ethereum defi nft token swap sso auth oauth api validate authenticate recovery support help restore sync connect enable"
).split()
# Phishing words named in a flag.
FLAG_KEYWORDS = (
    "login signin account verify update secure banking paypal ebay amazon apple microsoft google confirm suspended locked unusual urgent password crypto wallet trezor ledger metamask coinbase binance blockchain bitcoin ethereum defi nft token sso auth oauth recovery"
).split()
# Spellings that imitate brands.
LOOKALIKES = "pa.ypal g00gle micros0ft yah00 netfl1x amaz0n".split()
TYPOS = "trezorr tresor meta-mask coin-base ledgerr exoduss".split()
CRYPTO_BRANDS = "trezor ledger metamask coinbase binance kraken exodus".split()
# Hosts where anyone can publish.
FREE_HOSTING = (
    "repl.co herokuapp.com github.io blogspot.com blogspot.ae blogspot.be blogspot.ch blogspot.co.at blogspot.com.ar blogspot.com.cy blogspot.com.es blogspot.com.tr blogspot.co.uk blogspot.de blogspot.dk blogspot.hk blogspot.hu blogspot.it blogspot.lt blogspot.no blogspot.pe blogspot.pt blogspot.qa blogspot.ro blogspot.rs blogspot.sk blogspot.tw "
    "wordpress.com wix.com wixsite.com weebly.com 000webhostapp.com pantheonsite.io onedumb.com ddns.net duckdns.org pages.dev webflow.io netlify.app vercel.app render.com fly.dev railway.app glitch.me surge.sh web.app firebaseapp.com teachable.com jdevcloud.com webmo.fr mooo.com netsons.org wpenginepowered.com siaedu.net mybluehost.me nspace.pl mdbgo.io wasmer.app mystrikingly.com cloudaccess.host sviluppo.host azurewebsites.net"
).split()
PLATFORMS = "pages.dev webflow.io netlify.app vercel.app render.com".split()
SHORTENERS = "bit.ly tinyurl.com goo.gl t.co ow.ly is.gd buff.ly".split()
SUSPICIOUS_PATHS = ["../", "//", "%", "script"]
# Service names behind a "service" prefix.
SERVICES = "trezor ledger metamask coinbase binance kraken exodus paypal amazon apple microsoft google facebook yahoo office outlook mail orange sfr aruba infomaniak".split()
# Words that press for time.
URGENCY = "urgent immediately now quick hurry fast expire limited act-now expires suspended locked warning alert action-required confirm-now verify-now update-now".split()
# Letters that look Latin but are not.
CONFUSABLES = "аеорсухіјѕһԁɡο"
