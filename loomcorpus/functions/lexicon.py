"""Word lists."""

#: Words that carry no topic: English, Persian, and web markup.
STOP_WORDS = frozenset("""
themselves yourselves ourselves shouldnt yourself against because between couldnt further herself himself shouldn through wouldnt اینگونه
before cannot couldn doesnt during havent having itself mustnt myself should theirs theres theyll theyre theyve werent wheres wouldn آنگونه
خواهند خواهید خواهیم خودتان خودشان خودمان درباره دوباره همچنین about above after again arent being below class could didnt doesn doing every
hadnt hasnt haven heres https might mustn other ought shant shell since still thats their there these theyd those under until wasnt whats
whens where which while would youll youre yours youve امروز اندکی اکنون ایشان اینجا اینها باشند باشید باشیم بالای بسیار بودند بودید بودیم
خواهد خواهم خواهی دیروز دیگری زمانی مانند مرتبه هرچند هستند هستید هستیم همیشه پایین چگونه also aren aspx back been both cant didn does dont
down each else even from gets hadn hasn have hell here hers hows href html http into isnt just lets like more most much nbsp once only ours
over quot said same shan shed shes some span such than that them then they this very wasn well were weve what when whom whos whys will with
wont youd your آنان آنجا آنها اغلب باشد باشم باشی بدون برای برخی بعضی بلکه بودم بودی ترین تمام تنها توسط جلوی حالا حدود خودت خودش خودم خیلی
دیگر زیرا شوند صورت طریق فردا قسمت لیکن مورد میان نیست هرگز هزار هستم هستی همان همین هنوز وقتی چطور چنان چنین کنار گاهی گرچه all amp and any
are asp but can com css did div don few for get got had has hed her hes him his how htm ill isn its ive jsp let may net new nor not now off
one org our out own php she src the too two use was way wed who why won www you آری است اما اگر این بار باز بخش بعد بله بود بین جای حال حتی
خود خیر روز روی زیر سال سپس شده شما شود شکل طور عقب فقط قبل ماه نزد نمی نوع نیز های هست همه هیچ ولی پیش چرا چند چون کجا کمی am an as at be
by do gt he id if im in is it js ll lt me my no of on or re so to up us ve we آن از او ای با بر به بی تا تر تو جز در ده دو را سه شد صد ما من
می نه ها هر هم پس چه که کی یا یک a i و
""".split())

#: Query parameters that only track visitors or carry a way back.
TRACKING_PARAMETERS = frozenset("""
redirect_log_mongo_id redirect_mongo_id sb_referer_host callback_url redirect_uri redirect_url utm_campaign trkCampaign utm_content
return_url utm_medium utm_source li_fat_id utm_term hsa_acc hsa_cam hsa_grp hsa_net hsa_src hsa_tgt hsa_ver msclkid ref_src ref_url s_kwcid
_hsenc fbclid gclsrc hsa_ad hsa_kw hsa_mt igshid mc_cid mc_eid source zanpid _hsmi after dclid gclid _pos _ref back next _ga _gl _ss amp ref
src trk unt _t _v
""".split())

#: Files that hold no page text.
SKIPPED_EXTENSIONS = frozenset("""
.woff2 .docx .jpeg .pptx .tiff .webm .webp .woff .xlsx .apk .avi .bin .bmp .bz2 .dat .deb .dmg .doc .eot .exe .flv .gif .ico .ipa .iso .jpg
.m4a .mkv .mov .mp3 .mp4 .msi .odp .ods .odt .ogg .otf .pdf .pkg .png .ppt .rar .rpm .svg .tar .tif .ttf .wav .wmv .xls .zip .7z .gz .xz
""".split())

#: Names that subdomains often have.
HOST_PREFIXES = frozenset("""
autodiscover lyncdiscover autoconfig monitoring production analytics dashboard developer downloads inventory localhost accounts checkout
database download exchange internal intranet payments tracking account backups billing content monitor payment preview staging support
testing webdisk webmail assets backup cpanel gitlab images mobile office orders portal remote search secure server static status admin cache
cloud email files forum login mail2 mail3 media mysql oauth order panel proxy stage stats store video apps auth beta blog cart demo dns1
dns2 docs help home imap info live mail news prod shop smtp test wiki www1 www2 www3 api app cdn cms crm dev dns erp ftp git img mx1 mx2 new
ns1 ns2 ns3 ns4 old owa pop sip sql sso uat vpn web ww1 ww2 www db hr mx qa ww m
""".split())
