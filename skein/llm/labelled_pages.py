"""Small pages whose main text is marked, from which html_extract counts its weights: @@ begins and ends a marked part."""

A = "The ferry crossed the bay again on Monday after two years of repairs."
B = "Some three hundred people stood on the quay and most of them stayed until dark."
C = "No one could say when the harbour had last been so full."
D = "I do not know what you would say to this, or how we all came to look up at the same short word in our papers: it was about us, our home, the weather in June, the rain and the news on that site, and there was a little more to it."
MENU = "<ul><li><a>Home</a></li><li><a>News</a></li><li><a>Sport</a></li><li><a>About us</a></li></ul>"
LINKS = "<a>Home</a> <a>Archive</a> <a>Contact</a>"
BODY = f"<h1>Ferry returns</h1><p>{A}</p><p>{B}</p>"
MORE = f"<h2>What comes next</h2><p>{C}</p>"
REMARK = "<div><b>Ann says:</b><p>I do not believe a word of this.</p><a>Reply</a></div><div><b>Bo says:</b><p>Nice boat.</p><a>Reply</a></div>"
ALL_RIGHTS = "Copyright 2021 Harbour Press. All rights reserved."
COPY = "&copy; 2020 The Bay Company"
COOKIE = "We use cookies to improve this site. <button>Accept</button>"
MAIL = "<form>Subscribe to our newsletter <input><button>Sign up</button></form>"
TEASER = "<article><h3><a>Rain in June</a></h3><p>A short look at the weather.</p></article>"

PAGES = (
    f"<body><header><div class='logo'>Harbour Press</div><nav>{MENU}</nav></header>@@<article>{BODY}{MORE}</article>@@<footer><p>{ALL_RIGHTS}</p></footer></body>",
    f"<body><nav class='navbar menu'>{MENU}</nav>@@<main><article><header><h1>Ferry returns</h1><p class='byline'>By Jane Roe</p></header><p>{A}</p><figure><img><figcaption>The ferry at dusk.</figcaption></figure><p>{B}</p></article></main>@@<aside class='sidebar'><h3>Trending</h3>{LINKS}</aside><footer>{COPY}</footer></body>",
    f"<body><div id='menu'>{LINKS}</div>@@<div class='post'>{BODY}</div>@@<div class='comments'><h3>Comments</h3>{REMARK}</div><div class='footer'>{ALL_RIGHTS}</div></body>",
    f"<body><form id='aspnetForm'><div id='header'>{LINKS}</div>@@<article>{BODY}<p class='legal'>The ferry company gives no promise of arrival.</p></article>@@<div id='footer'>{COPY}</div></form></body>",
    f"<body><div class='layout sidebar-left'><div class='sidebar widget'><h3>Related articles</h3>{LINKS}</div>@@<div class='content'>{BODY}{MORE}</div>@@</div><div class='legal'>{ALL_RIGHTS}</div></body>",
    f"<body><h1>The Bay Company</h1>@@<div class='entry-content sharing-enabled'>{BODY}</div>@@<div class='sharing social'>Share this <a>Mail</a><a>Print</a></div><div id='copyright'>{COPY}</div></body>",
    f"<body><div class='cookie-notice'>{COOKIE}</div>@@<article><h1>Ferry returns</h1><p>{A} {D}</p>@@<div class='ad'>Buy two tickets and get one free</div>@@<p>{B}</p><section class='discussion'><h2>Discussion</h2><p>{C}</p></section></article>@@<section class='comments'><h3>Comments</h3>{REMARK}</section></body>",
    f"<body><div>{LINKS}</div>@@<div>{BODY}{MORE}</div>@@<div>{ALL_RIGHTS}</div></body>",
    f"<body><div>{MENU}</div>@@<h1>Ferry returns</h1><p>{A}</p><p>{B}</p>@@<p>{COPY}</p></body>",
    f"<body><nav>{MENU}</nav>@@<main>{BODY}<blockquote>{C}</blockquote></main>@@<section>{TEASER}{TEASER}</section><footer>{COPY}</footer></body>",
    f"<body>@@<main>{BODY}{MORE}</main>@@{TEASER}{TEASER}<div class='related recommended'><h3>Related articles</h3>{TEASER}</div></body>",
    f"<body><header>{LINKS}</header>@@<article>{BODY}@@<aside class='promo'>Sponsored: sleep better tonight</aside>@@<p>{C}</p>@@<div class='newsletter subscribe'>{MAIL}</div><div class='tags'><a>ferry</a><a>bay</a></div>@@</article>@@<div id='comments'><h3>3 Comments</h3>{REMARK}</div></body>",
    f"<body>@@<article>{BODY}{MORE}@@<div><h3>Comments</h3>{REMARK}</div></article></body>",
    f"<body>@@<article>{BODY}</article>@@<div><h3>Leave a reply</h3>{REMARK}</div><footer><div class='widget'>{LINKS}</div>{COPY}</footer></body>",
    f"<body><table><tr><td class='nav menu'>{MENU}</td><td>@@<h1>Ferry returns</h1><p>{A}</p><p>{B}</p>@@</td></tr></table><div class='footer'>{COPY}</div></body>",
    f"<body><div role='navigation'>{MENU}</div>@@<div role='main'>{BODY}{MORE}</div>@@<div role='complementary'><h3>Trending</h3>{LINKS}</div><div role='contentinfo'>{ALL_RIGHTS}</div></body>",
    f"<body><div role='banner'>Harbour Press {LINKS}</div>@@<div class='article-body'><p>{A}</p><p>{B}</p><p>{C}</p></div>@@<div role='search'><form><input>Search<button>Go</button></form></div></body>",
    f"<body><div class='modal popup overlay' hidden>Log in to read more <button>Log in</button></div>@@<article>{BODY}<ul><li>Boats at nine</li><li>Boats at ten</li></ul></article>@@<div class='author-box'><p>More by this author</p>{LINKS}</div></body>",
    f"<body><div class='topbar toolbar'>{LINKS}</div><div class='breadcrumb breadcrumbs'><a>Home</a> <a>News</a></div>@@<div class='story'>{BODY}<table><tr><th>Boat</th><th>Time</th></tr><tr><td>First</td><td>Nine</td></tr></table></div>@@<div class='pagination pager'><a>1</a><a>2</a></div></body>",
    f"<body><div class='advertisement adverts banner'>Cheap flights to the sun</div>@@<article class='post'>{BODY}@@<div class='advert adsense sponsor'>Our sponsor makes good shoes</div>@@<p>{C}</p></article>@@<div class='sponsored promotion'>New shoes for less</div></body>",
    f"<body><nav>{MENU}</nav><div class='alert notice'>Our offices are closed today</div>@@<article>{BODY}@@<div class='notice disclaimer'>You need a new browser for this page</div>@@<p>{C}</p></article>@@<div class='disclaimer'>Prices may change.</div></body>",
    f"<body>@@<article>{BODY}@@<div class='share social'><a>Mail</a> <a>Print</a></div><div class='related'><h3>You may also like</h3>{LINKS}</div><section id='comments' class='respond'>{REMARK}</section>@@</article>@@<footer>{COPY}</footer></body>",
    f"<body><aside class='rail'>{LINKS}<p>Most read stories</p></aside>@@<section class='text'>{BODY}{MORE}</section>@@<section class='recirc trending popular'><h2>More stories</h2>{TEASER}</section></body>",
    f"<body><div class='cookie-banner consent gdpr'>{COOKIE}</div>@@<main class='site-content'>{BODY}<p>{C}</p></main>@@<div class='site-footer'>{ALL_RIGHTS}</div></body>",
    f"<body><div class='masthead site-header'>{LINKS}</div>@@<article><p>{A}</p><pre>sail at nine</pre><p>{B}</p></article>@@<div class='disqus commentlist'>{REMARK}</div><div class='reviews'><p>Five stars from me.</p></div></body>",
    f"<body><div id='nav'>{MENU}</div>@@<div id='main'><div class='entry'>{BODY}<dl><dt>Quay</dt><dd>Where boats land.</dd></dl></div></div>@@<div id='sidebar'><h3>Newsletter</h3>{MAIL}<h3>Archive</h3>{LINKS}</div></body>",
    f"<body><p>Welcome back, dear reader of the daily mail</p>@@<article>{BODY}</article>@@<p>Powered by a small press</p></body>",
    f"<body><div class='search skip hidden'>Search this site</div>@@<article>{BODY}{MORE}@@<form><label>Your mail</label><input><button>Send</button></form><nav><a>Previous</a><a>Next</a></nav><footer>Filed under boats</footer>@@</article>@@<dialog>Do you want to leave?</dialog></body>",
    f"<body><div class='subscription signup login'>{MAIL}</div>@@<article>{BODY}<details><summary>How long?</summary><p>Two hours.</p></details></article>@@<div class='user-comments replies'>{REMARK}</div></body>",
    f"<body>@@<div class='blog-post content'>{BODY}</div>@@<div class='comment-list reader-comments'><h2>Reader comments</h2>{REMARK}</div><div class='related-posts'><h2>Related posts</h2>{LINKS}</div></body>",
    f"<body><select><option>English</option><option>French</option></select>@@<article>{BODY}<div class='legal'>{C}</div><p class='note'>{A}</p></article>@@<fieldset>Vote now <button>Yes</button></fieldset><menu>{MENU}</menu></body>",
    f"<body><div>{LINKS}</div>@@<div><h1>Ferry returns</h1><header><p>{A}</p></header><h3>Boats</h3><ul><li>{B}</li></ul><ol><li>{C}</li></ol><section><h4>Quays</h4><p>{A}</p></section><table><tr><td>{B}</td></tr></table><blockquote>{C}</blockquote></div>@@<p>{ALL_RIGHTS}</p></body>",
    f"<body>@@<article><h1>Ferry returns</h1><div><div><h3>Boats</h3><p>{A}</p></div><ol><li>{B}</li></ol><div>{C}</div></div><section><h4>Quays</h4><ul><li>{A}</li></ul></section></article>@@<div><h3>Related articles</h3>{LINKS}</div></body>",
    f"<body><nav>{MENU}</nav>@@<article><section><h2>Comments by the mayor</h2><p>{A}</p></section><section class='reviews'><h2>Reviews of the ferry</h2><p>{B}</p></section></article>@@<footer><p>{COPY}</p>{MENU}</footer></body>",
)
