"""User agents with the values expected for them: (agent, type, version, platform, mobile, robot).

Agent 9 is also the only one inside an AOL shell, version 9.0.
"""

# Fixed values.
GOLDEN_AGENTS = (
    (
        "Mozilla/5.0 (Windows NT 6.1) AppleWebKit/537.31 (KHTML, like Gecko) Chrome/26.0.1410.64 Safari/537.31",
        "Chrome", "26.0.1410.64", "Windows", False, False,
    ),
    (
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_8_3) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/27.0.1453.93 Safari/537.36",
        "Chrome", "27.0.1453.93", "Apple", False, False,
    ),
    (
        "Mozilla/5.0 (Linux; Android 4.2.2; Nexus 4) AppleWebKit/537.31 (KHTML, like Gecko) Chrome/26.0.1410.58 Mobile Safari/537.31",
        "Chrome", "26.0.1410.58", "Android", False, False,
    ),
    (
        "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:21.0) Gecko/20100101 Firefox/21.0",
        "Firefox", "21.0", "Linux", False, False,
    ),
    (
        "Mozilla/5.0 (Windows NT 6.1; rv:20.0) Gecko/20100101 Firefox",
        "Firefox", "", "Windows", False, False,
    ),
    (
        "Mozilla/4.0 (compatible; MSIE 8.0; Windows NT 6.1; Trident/4.0)",
        "Internet Explorer", "8.0", "Windows", False, False,
    ),
    (
        "Mozilla/4.0 (compatible;MSIE 7.0;Windows NT 5.1)",
        "Internet Explorer", "7.0", "Windows", False, False,
    ),
    (
        "Mozilla/5.0 (Windows NT 6.1; Trident/7.0; rv:11.0) like Gecko",
        "Mozilla", "5.0", "Windows", False, False,
    ),
    (
        "Microsoft Internet Explorer/4.0b1 (Windows 95)",
        "Internet Explorer", "1.5", "Windows", False, False,
    ),
    (
        "Mozilla/4.0 (compatible; MSIE 6.0; Windows NT 5.1; AOL 9.0; .NET CLR 1.1)",
        "Internet Explorer", "6.0", "Windows", False, False,
    ),
    (
        "Mozilla/4.0 (compatible; MSIE 6.0; MSN 2.5; Windows 98; MSNbMSFT)",
        "MSN Browser", "2.5", "Windows", False, False,
    ),
    (
        "Mozilla/1.1 (compatible; MSPIE 2.0; Windows CE)",
        "Pocket Internet Explorer", "2.0", "Windows CE", True, False,
    ),
    (
        "Opera/9.80 (Windows NT 6.1; U; en) Presto/2.7.62 Version/10.63",
        "Opera", "10.63", "Windows", False, False,
    ),
    (
        "Opera/9.80 (Windows NT 6.1) Presto/2.12.388 Version/12.15",
        "Opera", "9.80", "Windows", False, False,
    ),
    (
        "Mozilla/4.0 (compatible; MSIE 6.0; Windows NT 5.1; en) Opera 8.50",
        "Opera", "8.50", "Windows", False, False,
    ),
    (
        "Opera/9.80 (J2ME/MIDP; Opera Mini/4.2.13337/458; U; en) Presto/2.2.0",
        "Opera Mini", "4.2.13337", "unknown", True, False,
    ),
    (
        "Mozilla/5.0 (X11; U; Linux i686; en) Gecko/20031114 Galeon/1.3.11a",
        "Galeon", "1.3.11a", "Linux", False, False,
    ),
    (
        "Mozilla/5.0 (Windows; U; rv:1.8.1.8) Gecko/20071019 Firefox/2.0.0.8 Navigator/9.0RC1",
        "Netscape Navigator", "9.0RC1", "Windows", False, False,
    ),
    (
        "Mozilla/5.0 (Macintosh; U; PPC Mac OS X; en-US) AppleWebKit/85 (KHTML, like Gecko) OmniWeb/v496",
        "OmniWeb", "v496", "Apple", False, False,
    ),
    (
        "Mozilla/5.0 (Linux; U; Android 2.2; en-us; Nexus One) AppleWebKit/533.1 Version/4.0 Mobile Safari/533.1",
        "Android", "2.2", "Android", True, False,
    ),
    (
        "Mozilla/5.0 (iPad; CPU OS 5_0 like Mac OS X) AppleWebKit/534.46 Version/5.1 Mobile/9A334 Safari/7534.48.3",
        "iPad", "5.1", "iPad", True, False,
    ),
    (
        "Mozilla/5.0 (iPod; U; CPU iPhone OS 4_1 like Mac OS X) AppleWebKit/532.9 Version/4.0.5 Mobile/8B118",
        "iPod", "4.0.5", "iPod", True, False,
    ),
    (
        "Mozilla/5.0 (iPhone; CPU iPhone OS 6_0 like Mac OS X) AppleWebKit/536.26 Mobile/10A403",
        "iPhone", "unknown", "iPhone", True, False,
    ),
    (
        "BlackBerry8330/4.3.0 Profile/MIDP-2.0 VendorID/105",
        "BlackBerry", "4.3.0", "BlackBerry", True, False,
    ),
    (
        "Mozilla/5.0 (SymbianOS/9.1; U; Series60/3.0 NokiaE60/4.06.0) AppleWebKit/413",
        "Nokia S60 OSS Browser", "4.06.0", "Nokia", True, False,
    ),
    (
        "Nokia6230/2.0 (05.50) Profile/MIDP-2.0",
        "Nokia Browser", "2.0", "Nokia", True, False,
    ),
    (
        "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
        "GoogleBot", "2.1", "unknown", False, True,
    ),
    (
        "msnbot/1.1 (+http://search.msn.com/msnbot.htm)",
        "MSN Bot", "1.1", "unknown", False, True,
    ),
    (
        "Mozilla/5.0 (compatible; Yahoo! Slurp; http://help.yahoo.com/help)",
        "Yahoo! Slurp", "", "unknown", False, True,
    ),
    (
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_8) AppleWebKit/536.26 Version/6.0 Safari/536.26",
        "Safari", "6.0", "Apple", False, False,
    ),
    (
        "Mozilla/5.0 (Macintosh; PPC Mac OS X) AppleWebKit/85 Safari/85",
        "Safari", "unknown", "Apple", False, False,
    ),
    (
        "Mozilla/3.0 (compatible; NetPositive/2.2.1; BeOS)",
        "NetPositive", "2.2.1", "BeOS", False, False,
    ),
    (
        "Mozilla/5.0 (X11; U; Linux i686; rv:1.5a) Gecko/20030728 Mozilla Firebird/0.6.1 Plug/1",
        "Firebird", "0.6.1Plug", "Linux", False, False,
    ),
    (
        "Mozilla/5.0 (compatible; Konqueror/3.5; SunOS) KHTML/3.5.0",
        "Konqueror", "3.5", "SunOS", False, False,
    ),
    (
        "iCab/2.9.8 (Macintosh; U; PPC; Mac OS X)",
        "iCab", "2.9.8", "Apple", False, False,
    ),
    (
        "Mozilla/5.0 (Windows; U; Win98) Gecko/20020930 Phoenix/0.2",
        "Phoenix", "0.2", "Windows", False, False,
    ),
    (
        "amaya/9.51 libwww/5.4.0",
        "Amaya", "9.51", "unknown", False, False,
    ),
    (
        "Lynx/2.8.5rel.1 libwww-FM/2.14",
        "Lynx", "2.8.5rel.1", "unknown", False, False,
    ),
    (
        "Mozilla/5.0 (X11; FreeBSD amd64) Gecko/20090427 Shiretoko/3.5b4",
        "Shiretoko", "3.5b4", "FreeBSD", False, False,
    ),
    (
        "Mozilla/5.0 (X11; OpenBSD; U) Gecko/2008 IceCat/3.0.1-g1",
        "IceCat", "3.0.1-g1", "OpenBSD", False, False,
    ),
    (
        "W3C-checklink/4.5 libwww-perl/5.8",
        "W3C Validator", "4.5", "unknown", False, False,
    ),
    (
        "W3C_Validator 1.654",
        "W3C Validator", "1.654", "unknown", False, False,
    ),
    (
        "Mozilla/5.0 (X11; U; NetBSD i686; rv:1.8.1) Gecko/2006 Iceweasel/2.0",
        "Mozilla", "1.8", "NetBSD", False, False,
    ),
    (
        "Mozilla/4.0 WebTV/2.6 (compatible)",
        "WebTV", "2.6", "unknown", False, False,
    ),
    (
        "MyApp/1.0 CFNetwork/609 Darwin/13.0.0",
        "unknown", "unknown", "Windows", False, False,
    ),
    (
        "curl/7.29.0",
        "unknown", "unknown", "unknown", False, False,
    ),
    (
        "",
        "unknown", "unknown", "unknown", False, False,
    ),
)

AOL_AGENT, AOL_VERSION = 9, "9.0"
