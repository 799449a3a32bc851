"""Words for the URL filter: a rank-ordered lexicon for the segmenter, and words of sites by kind, from which training names are made.

All lists are general knowledge; a word may be in several.
"""

from __future__ import annotations

#: Everyday words of names and paths, the most frequent first; a word's frequency falls with its rank.
RANKED = (
    "the of and to in a for on is with by at from my your all new home page about search free more use up out web news one first info site contact business what time view also other only click "
    "service services price people year state email world music after video where books system health high public over text name work product products company group program school data "
    "review reviews back item city order area year years list well made online day team help map site data park support shop store forum blog post posts article articles wiki index category tag tags user users login "
    "account admin app apps api docs download files file image images photo photos gallery media press radio tv film films movie movies game games play player sport sports football soccer tennis golf hockey "
    "baseball basketball cricket racing run running bike cycling fitness yoga weather travel hotel hotels flight flights tour tours trip holiday beach island mountain river lake sea ocean water fire earth air sun moon star stars sky "
    "north south east west street road house garden kitchen room door window wall floor roof furniture design art arts artist museum history science research university college academy library student students teacher teachers class "
    "course courses learn learning training education study test exam language english french german spanish italian chinese japanese russian dutch portuguese food recipe recipes cook cooking bake baking cake bread cheese wine beer coffee tea chocolate fruit apple "
    "orange lemon rice fish meat chicken vegan restaurant cafe bar pizza family kids child children baby mother father parent parents women men woman man girl girls boy boys wedding love life live living style fashion clothes shoes dress beauty hair skin care doctor medical "
    "medicine hospital clinic dental dentist nurse cancer heart diet nutrition mental pharmacy vet animal animals dog dogs cat cats horse bird birds pet pets farm plant plants flower flowers tree trees nature green eco energy solar power electric car cars auto motor "
    "truck boat ship train bus bank money finance financial tax insurance invest investment market markets stock trade trading economy law legal lawyer court police army government president council office job jobs career careers staff hire "
    "tech technology software hardware computer computers mobile phone phones laptop code coding developer developers open source project projects linux cloud server network security digital electronic electronics engineering engineer build builder building construction machine tool tools "
    "repair parts clean cleaning safe safety fast easy best top good great big little small old young red blue black white gold silver pink purple yellow brown grey happy smart simple modern classic local global national international world wide daily weekly monthly today now "
    "times journal magazine gazette herald post tribune chronicle review guide report reports story stories letter letters book bookstore reader reading write writer writing poem poetry novel paper print printing card cards gift gifts toy toys craft crafts paint painting draw drawing "
    "song songs band guitar piano drum jazz rock pop dance theatre theater opera festival event events ticket tickets party club church christian bible faith god temple king queen prince castle bridge tower hill valley forest wood stone metal iron steel glass "
    "plastic rubber oil gas coal mine mining agriculture land property estate real rent rental sale sales buy sell deal deals discount coupon cheap market shopping cart checkout payment pay credit loan loans mortgage debt bill cash coin fund funding charity volunteer community social network friend friends "
    "chat message mail letter email newsletter subscribe join member members membership profile member password secure privacy policy terms faq help center centre central union federal united american america canada australia europe africa asia india china japan korea russia germany france spain "
    "italy england scotland ireland wales london paris berlin york angeles francisco chicago boston texas california florida washington toronto sydney madrid rome vienna tokyo mexico brazil argentina chile peru poland sweden norway denmark finland greece turkey egypt israel "
    "smith jones brown johnson williams miller davis wilson taylor thomas martin anderson thompson robinson clark lewis walker hall allen king scott adams baker nelson carter mitchell david john james robert michael william mary anna maria peter paul mark george charles daniel "
    "experts exchange expert therapist therapy essex sussex middlesex wessex sexton analysis analyst analytics analog cocktail cocktails cockpit peacock hancock assassin assess assessment asset assets class classic classes classical glass grass mass pass passage passion password "
    "bass brass compass assist assistant associate association document documents cucumber circumstance accumulate title constitution institute prostitution titan button buttons butter butterfly scunthorpe shitake pussycat cumbria cumberland dickens dickinson dickson "
    "grape grapes drape scrape therapeutic camera cameras campus camp camping campaign cambridge alphabet better betting beta between tibet diabetes elizabeth slot slots hacker hackers hackathon hack cracker crackers torrent current currents apparel nudge canude "
    "spa spam spanish span escort escape dating data update updates updating candidate validating hotel hotline hot shot photo photography photographer specialist specialists socialist special specials racial commercial official social financial crucial pill pillar pillow pills "
    "caterpillar adult adults adulthood poker pokemon casino casinos lottery pilot pilots lot lots plot plots loan sloan alone phishing fishing fish fisher fisherman malware software hardware warehouse aware award awards replica republic reptile winner winners dinner beginner beginners win wins wine winery twin twins window windows winter "
    "weekend week weekly month year hour minute second clock watch watches jewelry jewellery ring rings diamond pearl perfume cosmetics makeup nails salon spa massage barber tattoo fitness gym muscle sports swim swimming surf surfing ski skiing snow ice climb climbing hike hiking fishing hunting camping outdoor outdoors adventure "
    "space rocket nasa planet astronomy physics chemistry biology math maths mathematics geography geology philosophy psychology sociology economics politics political vote voting election democracy party minister parliament senate congress citizen rights human humanity culture cultural society heritage tradition archive archives record records "
    "statistics survey number numbers count counter calculator converter translate translator dictionary encyclopedia reference manual tutorial lesson lessons lecture notes homework essay thesis grade score result results answer answers question questions quiz puzzle chess board boards "
    "video videos stream streaming watch channel episode season series show shows cinema actor actress director studio studios record label album lyrics concert tour stage audio sound voice podcast microphone speaker headphone camera lens light lighting lamp bulb battery charger cable wire wireless router modem internet online offline "
    "site sites page pages link links host hosting domain domains register registry browser chrome firefox safari windows android iphone apple google microsoft amazon facebook twitter youtube wikipedia github python java javascript script scripts database query table column field row form forms template theme plugin widget module package version release update patch bug fix error debug test testing "
    "www http https html php asp com net org edu gov co uk de fr es en id it us eu ru jp cn au ca br nl be ch at pl se no dk fi"
).split()

#: Sites that a crawl leaves out, by kind.
BLOCKED = {
    "adult": (
        "x porn porno pornstar pornstars xxx sex sexy sexual nude nudes naked nudity erotic erotica hentai milf milfs lesbian lesbians gangbang blowjob handjob anal oral pussy cock dick cum cumshot boobs tits busty ass bigtits slut sluts whore whores hooker hookers escort escorts callgirl callgirls stripper strippers "
        "striptease camgirl camgirls cams camsex webcam webcams fetish bdsm bondage swinger swingers hookup hookups threesome orgy orgasm dildo dildos vibrator sextoy sextoys toys upskirt voyeur amateur teen teens hot girls adult adults dating hotdating singles lust kinky fuck fucking fucked horny playboy topless lingerie massage nsfw rule camshow livesex freeporn tube tubes redtube videos pics gay shemale tranny incest"
    ),
    "gambling": (
        "casino casinos poker bet bets betting bettor bookie bookies bookmaker bookmakers wager wagers wagering gamble gambling gambler slot slots slotmachine jackpot jackpots roulette blackjack baccarat craps bingo lotto lottery lotteries sportsbook sportsbooks sportsbet livebet odds freespins spins spin bonus payout payouts dealer highroller keno parlay winbig tipster tips togel situs judi"
    ),
    "pharma": (
        "viagra cialis levitra sildenafil tadalafil xanax valium tramadol ambien phentermine oxycontin vicodin adderall steroid steroids pills pill meds rx pharmacy pharma drugstore noprescription prescription generic erection erectile penis enlargement enhancement viagraonline weightloss slimming diet ketopills kamagra modafinil opioid cannabis thc kratom vape"
    ),
    "warez": (
        "warez crack cracks cracked cracker keygen keygens serial serials nulled torrent torrents pirate pirated piratebay rapidshare megaupload hack hacks hacked hacking cheat cheats cheatcodes aimbot wallhack trainer malware spyware adware ransomware trojan virus keylogger botnet ddos exploit exploits phish phishing carding cvv dumps fullz darknet onion leaked leaks passwords bypass unlocker rootkit rat stealer booter"
    ),
    "scam": (
        "payday paydayloan paydayloans loan loans cashadvance cash fastcash quickcash easymoney makemoney earnmoney getrich rich millionaire workfromhome mlm pyramid ponzi forex binary binaryoptions bitcoin crypto doubler investment hyip replica replicas fake knockoff counterfeit rolex louis vuitton cheap discount prize prizes winner winners win giveaway sweepstakes free click clicks ppc popup popups popunder ads adclick traffic spam spammer scam scams fraud essaywriting buyessays fakeid followers likes seo backlinks backlink psychic tarot debt consolidation"
    ),
}
#: Other sites, by kind.
ALLOWED = {
    "news": "news daily times journal herald tribune gazette post press report reporter world local politics opinion editorial headline headlines breaking live weather today magazine weekly morning evening radio tv broadcast media newspaper chronicle observer telegraph",
    "learning": "school university college academy institute library student teacher education course courses learn learning lesson study science research history math physics chemistry biology geography philosophy psychology language english french german grammar dictionary encyclopedia wiki article page book books reading literature poetry journal thesis museum archive lecture exam sexual health",
    "technology": "tech technology software hardware computer code coding developer developers docs documentation api github python java linux open source project cloud server data database network security blog tutorial forum help support download app apps web design hosting domain mobile phone review stack exchange experts engineering electronics robot hackathon torrent",
    "home": "home garden kitchen furniture house room decor design paint tools repair plumbing electric roof flooring lighting family kids baby mother parents pets dog dogs cat cats plant flowers farm craft crafts sewing knitting toys gift gifts wedding",
    "food": "food recipe recipes cook cooking bake baking kitchen restaurant cafe coffee tea wine beer cheese bread cake chocolate fruit vegan vegetarian pizza chef dinner lunch breakfast menu market organic fresh grill cocktail cocktails",
    "health": "health medical medicine doctor hospital clinic dental nurse nursing cancer heart diabetes diet nutrition fitness yoga therapy therapist mental wellness care pharmacy sleep exercise running patient research women men pregnancy",
    "travel": "travel hotel hotels flight flights tour tours trip guide map island beach city country mountain camping hiking cruise train bus car rental holiday vacation adventure visit tourism park museum london paris berlin york island hostel airport",
    "commerce": "shop store shopping buy sale price product products brand fashion clothes shoes dress jewelry watch watches bookstore electronics camera auto parts cars bike outlet deals discount cheap catalog order shipping company business service services office print marketing group consulting",
    "money": "bank banking finance financial insurance tax accounting invest investment stock market mortgage credit loan savings fund pension economy trade business real estate property law lawyer legal attorney",
    "culture": "art arts artist gallery museum music song band concert guitar piano theatre theater film films movie movies cinema photo photography dance festival event tickets opera jazz rock poetry culture heritage radio video comics anime animation education",
    "sport": "sport sports football soccer basketball baseball tennis golf hockey cricket rugby racing cycling bike running marathon swimming ski snow surf climbing fishing hunting club team league match score player coach stadium olympics girls boys teens amateur",
    "games": "game games gaming play player puzzle chess board cards video console nintendo xbox playstation minecraft pokemon rpg strategy fun quiz kids guide wiki cheat win tips",
    "public": "government council city state federal police court law vote election public community service charity church faith bible temple volunteer foundation union association society national international army veterans environment energy solar climate nature wildlife park water",
    "plain": "index about contact home page post blog article news info faq help terms privacy view category tag archive search m www the my our your new best top online site web net free live hot big pro one all",
}
#: What names of either sort have beside their word.
PARTNERS = "free best top my the online live new site web world club zone hub now city land hq pro net home daily big hot shop store today page guide blog forum".split()
