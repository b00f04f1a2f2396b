"""Pages written by hand, in layouts that the generator of training pages does not make; ``[[`` opens main text."""

_LONG = "The river rose by two metres in the night, and the lower road was closed before the first bus came."
_MORE = "Most of the shops on the square opened late, while volunteers carried sandbags to the old mill."
_LAST = "By noon the water had begun to fall again, though nobody expected the bridge to open before Friday."

GRID_BYLINE = f"""<html><head><title>Flood</title></head><body><div id="app"><div class="topbar"><a href="/">Valley Post</a>
<a href="/n">News</a><a href="/s">Sport</a></div><div class="container-fluid"><div class="row"><div class="col-md-9">
<h1>[[Flood closes the lower road</h1><div class="byline">[[By Ann Lee</div><p>[[{_LONG}</p><p>[[{_MORE}</p><p>[[{_LAST}</p>
<p>[[{_LONG}</p><p>[[{_MORE}</p></div><div class="col-md-3"><div class="card"><div class="card-header">Most read</div>
<div class="card-body"><a href="/1">Mill for sale</a><a href="/2">New school opens</a></div></div></div></div></div>
<div class="page-bottom">&copy; 2021 Valley Post. All rights reserved.</div></div></body></html>"""

NEWS_FIGURE = f"""<body><header class="global"><a href="/">The Herald</a><nav><ul><li><a href="/w">World</a></li><li><a href="/l">Local</a></li>
</ul></nav></header><main id="maincontent"><article><header><h1>[[Night of the flood</h1><p class="standfirst">[[Two metres in one night, and a
town without a road.</p><div class="meta"><span>[[Tom Ash</span> <time datetime="2021-03-04">4 March 2021</time></div></header>
<figure><img src="a.jpg"><figcaption>[[The square at dawn. Photograph: R. Hill</figcaption></figure><p>[[{_LONG}</p><h2>[[What happened</h2><p>[[{_MORE}</p>
<ul><li>[[Lower road closed</li><li>[[Mill without power</li></ul><p>[[{_LAST}</p><aside class="related-links"><h3>Read more</h3><a href="/q">Flood of 1954</a></aside>
</article></main><footer><a href="/t">Terms</a><a href="/c">Contact us</a><p>&copy; Herald Ltd</p></footer></body>"""

TABLE_LAYOUT = f"""<html><body bgcolor="white"><table width="100%"><tr><td colspan="2"><font size="5"><a href="/">Hill walkers' club</a></font></td></tr>
<tr><td width="150" valign="top"><a href="a.htm">Home</a><br><a href="b.htm">Walks</a><br><a href="c.htm">Members</a><br><a href="d.htm">Links</a></td>
<td valign="top"><h1>[[Spring walks</h1><p>[[{_LONG}<p>[[{_MORE}<p>[[{_LAST}</td></tr>
<tr><td colspan="2"><center><small>Copyright 1999 Hill walkers' club</small></center></td></tr></table></body></html>"""

HASHED_NAMES = f"""<body><div id="__next"><div class="css-1ab9xk"><div class="css-88ueq"><a href="/">Log in</a><a href="/j">Sign up</a></div></div>
<div class="css-0kd"><div class="css-pq2"><h1 class="css-t1">[[How the mill works</h1><div class="css-z9"><span>[[12 May 2020</span></div>
<div class="css-71"><p class="css-p">[[{_MORE}</p><p class="css-p">[[{_LONG}</p><blockquote class="css-b">[[{_LAST}</blockquote><p class="css-p">[[{_LONG}</p></div></div></div>
<div class="css-f"><div><a href="/about">About</a><a href="/jobs">Jobs</a><a href="/privacy">Privacy</a></div></div></div></body>"""

BLOG = f"""<body class="home blog"><div id="page" class="hfeed"><div id="branding"><h2><a href="/">A walker's diary</a></h2><p>Notes from the hills</p></div>
<div id="access"><ul><li><a href="/">Home</a></li><li><a href="/about">About me</a></li></ul></div><div id="primary"><div class="hentry">
<h1 class="entry-title">[[Up the north ridge</h1><div class="entry-meta">[[Posted on 3 June 2018 by walker</div><div class="entry-content"><p>[[{_LONG}</p>
<div class="wp-caption"><img src="x.jpg"><p class="wp-caption-text">[[The ridge in June</p></div><p>[[{_MORE}</p><p>[[{_LAST}</p></div></div>
<div id="comments"><h3>2 thoughts on this walk</h3><ol><li><div class="comment-author">Meg</div><p>Lovely pictures, we went there last year too.</p></li>
<li><div class="comment-author">Sam</div><p>Is the ladder still there?</p></li></ol><form><label>Name</label><input><label>Comment</label><textarea></textarea></form></div></div>
<div id="secondary"><h3>Archives</h3><ul><li><a href="/5">May 2018</a></li><li><a href="/4">April 2018</a></li></ul></div>
<div id="colophon">Proudly made by hand</div></div></body>"""

GERMAN = f"""<body><div class="cookiehinweis"><p>Wir verwenden Cookies. Mehr in unserer Datenschutz-Seite.</p><button>Akzeptieren</button></div>
<div class="kopf"><a href="/">Talblatt</a></div><div class="inhalt"><div class="artikel"><h1>[[Hochwasser im Tal</h1><p class="datum">[[4. März 2021</p>
<p>[[Der Fluss stieg in der Nacht um zwei Meter, und die untere Straße wurde gesperrt, bevor der erste Bus kam.</p>
<p>[[Die meisten Läden am Platz öffneten spät, während Freiwillige Sandsäcke zur alten Mühle trugen.</p>
<p>[[Bis Mittag begann das Wasser zu fallen, doch niemand rechnete mit der Brücke vor Freitag.</p></div>
<div class="kommentare"><h2>Kommentare</h2><div><b>Jana</b><p>Bei uns im Keller stand es auch.</p><a href="#">Antworten</a></div></div></div>
<div class="fuss"><a href="/i">Impressum</a> <a href="/d">Datenschutz</a> Alle Rechte vorbehalten</div></body>"""

DOCS = f"""<body><div class="layout"><div class="left-pane"><ul><li><a href="1">Install</a></li><li><a href="2">Configure</a><ul><li><a href="3">Files</a></li></ul></li></ul></div>
<main><div class="crumbs"><a href="/">Docs</a> / <a href="/c">Configure</a></div><h1>[[Configure the pump</h1><p>[[{_MORE}</p><pre><code>[[pump --rate 4</code></pre>
<dl><dt>[[rate</dt><dd>[[Litres in a second.</dd><dt>[[depth</dt><dd>[[Metres below the ground.</dd></dl><h2>[[Limits</h2><p>[[{_LAST}</p>
<table><tr><th>[[Rate</th><th>[[Depth</th></tr><tr><td>[[4</td><td>[[12 m</td></tr></table></main></div><footer>Last built yesterday</footer></body>"""

BARE = f"""<h1>[[Letter to the council</h1><p>[[{_LONG}</p><p>[[{_MORE}</p><p>[[{_LAST}</p><p>[[A. Lee</p>"""

TWO_COLUMNS = f"""<body><div class="wrap"><div class="lhs"><div class="card"><h5>Popular</h5><p><a href="/1">Mill for sale</a></p><p><a href="/2">New school opens</a></p></div>
<div class="card"><h5>Weather</h5><p>Rain, 8 degrees</p></div></div><div class="rhs"><h1>[[Flood closes the road</h1><div class="byline">[[By Ann Lee, staff writer</div>
<p>[[{_LONG}</p><p>[[{_MORE}</p><p>[[Nobody was hurt.</p><p>[[{_LAST}</p></div></div></body>"""

FRENCH = f"""<body><nav class="barre"><a href="/">Accueil</a><a href="/s">Sports</a></nav><section class="corps"><h1>[[La crue ferme la route</h1>
<p class="chapo">[[Deux mètres en une nuit, et une ville sans route.</p><p>[[La rivière a monté de deux mètres dans la nuit, et la route basse a fermé avant le premier bus.</p>
<p>[[La plupart des boutiques de la place ont ouvert tard, pendant que des volontaires portaient des sacs de sable.</p>
<div class="pub">Publicité</div><p>[[À midi l'eau a commencé à baisser, mais personne n'attendait le pont avant vendredi.</p></section>
<section class="reactions"><h2>Commentaires</h2><p>Chez nous aussi.</p><a href="#">Répondre</a></section><footer>Mentions légales. Tous droits réservés.</footer></body>"""

LAYOUTS = {
    "grid with byline": GRID_BYLINE, "news with figure": NEWS_FIGURE, "table layout": TABLE_LAYOUT, "hashed names": HASHED_NAMES, "blog": BLOG,
    "german": GERMAN, "manual": DOCS, "bare": BARE, "two columns": TWO_COLUMNS, "french": FRENCH,
}
